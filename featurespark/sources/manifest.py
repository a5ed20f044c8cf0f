"""The commit log of an ingest output, and small files read and written through the Hadoop file system.

``<root>/_log/<version>.json`` are the published states, numbered from 1. A version is created, never replaced, and holds
the whole state: which run's files are each layer's current ones, the registry, the markers and runs that are done. Readers
take the highest version, so they see all of a commit or nothing of it. A writer reads version ``n``, makes its change
and creates ``n + 1``; if another writer was faster it reads again what has become of the state, asks whether its change still holds, and
tries the next number. So no commit is ever lost, whichever processes run at the same time.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

LOG = "_log"
KEPT_VERSIONS = 20         # older ones may be removed; a writer that far behind starts over
EMPTY = {"version": 0, "layers": {}, "geojson": {}, "tiles": {}, "facts": {}, "registry": None, "runs": [], "markers": {},
         "uncleaned": [], "commit": {}}


class Conflict(Exception):
    """Another commit changed what this one is built on."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def literal_path(path: str) -> str:
    """A path for Spark's readers, which take patterns: special characters stand for themselves."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write(fs, path, text: str) -> None:
    out = fs.create(path, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def _rename(spark: SparkSession, fs, fresh, target, overwrite: bool) -> None:
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE if overwrite else kind.NONE
    context.rename(fs.makeQualified(fresh), fs.makeQualified(target), how)


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a new file beside ``path`` and rename it over the old one, so readers see either whole."""
    fs, target = _fs(spark, path)
    _, fresh = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    _write(fs, fresh, text)
    _rename(spark, fs, fresh, target, True)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create ``path`` with all of ``text`` unless it exists; whether it did. Of several callers at once one succeeds.

    A local file is linked to its name and a file of HDFS renamed without replacing, which are atomic; object stores, whose rename is
    not, get a create that asks the store to refuse an existing object.
    """
    jvm = spark.sparkContext._jvm
    fs, target = _fs(spark, path)
    scheme = fs.getUri().getScheme()
    if scheme in ("s3a", "s3", "gs", "abfs", "abfss"):
        try:
            out = fs.createFile(target).overwrite(False).recursive() \
                .opt("fs.option.create.conditional.overwrite", True).build()
            out.write(bytearray(text.encode("utf-8")))
            out.close()
            return True
        except Exception:
            if fs.exists(target):
                return False
            raise
    _, fresh = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    _write(fs, fresh, text)
    try:
        if scheme == "file":
            files = jvm.java.nio.file.Files
            files.createLink(jvm.java.io.File(target.toUri().getPath()).toPath(),
                             jvm.java.io.File(fresh.toUri().getPath()).toPath())
        else:
            _rename(spark, fs, fresh, target, False)
        return True
    except Exception:
        if fs.exists(target):
            return False
        raise
    finally:
        fs.delete(fresh, False)


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, f"{root}/{LOG}")
    if not fs.exists(p):
        return []
    names = [re.fullmatch(r"(\d+)\.json", st.getPath().getName()) for st in fs.listStatus(p)]
    return sorted(int(m[1]) for m in names if m)


def version_path(root: str, version: int) -> str:
    return f"{root}/{LOG}/{version:012d}.json"


def read_version(spark: SparkSession, root: str, version: int) -> dict:
    return json.loads(read_text(spark, version_path(root, version)))


def read_manifest(spark: SparkSession, root: str) -> dict | None:
    """The published state of an ingest output; None where layers simply lie under the root."""
    found = versions(spark, root)
    return read_version(spark, root, found[-1]) if found else None


def commit(spark: SparkSession, root: str, change: Callable[[dict], dict], base: int | None = None,
           holds: Callable[[dict], bool] = lambda commit: True) -> dict:
    """Publish ``change(state)`` as the next version and return it.

    ``holds`` is asked about the ``commit`` entry of every version since ``base`` (what the change was prepared on);
    if it denies one, ``Conflict`` is raised and nothing is published.
    """
    seen = base
    while True:
        found = versions(spark, root)
        state = read_version(spark, root, found[-1]) if found else json.loads(json.dumps(EMPTY))
        if seen is not None:
            for v in range(seen + 1, state["version"] + 1):
                if v not in found or not holds(read_version(spark, root, v)["commit"]):
                    raise Conflict(f"version {v} of {root}")
            seen = state["version"]
        new = change(state) | {"version": state["version"] + 1}
        if put_if_absent(spark, version_path(root, new["version"]), json.dumps(new, indent=1)):
            return new


def trim_log(spark: SparkSession, root: str) -> int:
    """Delete all but the last ``KEPT_VERSIONS`` versions."""
    old = versions(spark, root)[:-KEPT_VERSIONS]
    for v in old:
        fs, p = _fs(spark, version_path(root, v))
        fs.delete(p, False)
    return len(old)
