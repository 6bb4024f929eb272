"""Model packages: files that a manifest lists, taken whole or not at all.

A manifest has a row a file: `model`, `nth` (its order), `path`, `bytes`, `sha256` (lowercase hex). A file stands for
the first entry of a model whose path ends in the same name. Of several files for one entry the last one, by path,
whose size fits stands, else the first. A package is imported when all of its entries are there and each has the
size and digest listed. Digests are made where files are read, so contents are never shuffled to be checked.

Defined results: a backslash counts as a slash; a null path or content is no file; a manifest of repeated rows counts
each; a model without files misses all of its entries; files that no entry asks for are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _name(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def entries(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """model, nth, path, found (path of the file, or null) and status of each entry: missing, mismatch or fits.

    files has path and content, as the reader of binary files gives them.
    """
    known = files.filter("path is not null and content is not null").select(
        _name(F.col("path")).alias("name"), F.octet_length("content").cast("long").alias("size"), F.struct("path", F.sha2("content", 256).alias("digest")).alias("file")
    )
    # a name that many files or entries share is combined on the map side before anything meets
    sizes = known.groupBy("name", "size").agg(F.min("file").alias("least"), F.max("file").alias("last"))
    listed = manifest.select("model", "nth", "path", F.col("bytes").cast("long").alias("bytes"), "sha256", _name(F.col("path")).alias("name"))
    first = listed.groupBy("model", "name").agg(F.min(F.struct("nth", "path", "bytes")).alias("first"))
    fitting = F.max(F.when(F.col("size") == F.col("first.bytes"), F.struct(F.col("last").alias("file"), "size")))
    any_file = F.min(F.struct(F.col("least").alias("file"), "size"))
    taken = first.join(sizes, "name", "left").groupBy("model", "name", "first").agg(F.coalesce(fitting, any_file).alias("taken"))
    both = listed.join(taken, ["model", "name"])
    own = (F.col("nth") == F.col("first.nth")) & (F.col("path") == F.col("first.path")) & F.col("taken.file").isNotNull()
    status = (
        F.when(~own, "missing")
        .when((F.col("taken.size") == F.col("bytes")) & (F.col("taken.file.digest") == F.col("sha256")), "fits")
        .otherwise("mismatch")
    )
    return both.select("model", "nth", "path", F.when(own, F.col("taken.file.path")).alias("found"), status.alias("status"))


def imports(checked: DataFrame) -> DataFrame:
    """model, ok, stored, reason, n_missing and detail: the first path in order that is missing, else that does not match.

    The paths of all that are missing stay rows of `entries`, as a package may miss any number of them.
    """
    first = lambda status: F.min(F.when(F.col("status") == status, F.struct("nth", "path")))["path"]
    rows = checked.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "missing").alias("n_missing"), first("missing").alias("missing"), first("mismatch").alias("wrong")
    )
    ok = F.col("missing").isNull() & F.col("wrong").isNull()
    return rows.select(
        "model",
        ok.alias("ok"),
        F.when(ok, F.col("n")).otherwise(F.lit(0)).cast("long").alias("stored"),
        F.when(F.col("n_missing") > 0, "missing").when(F.col("wrong").isNotNull(), "mismatch").alias("reason"),
        "n_missing",
        F.coalesce("missing", "wrong").alias("detail"),
    )


def stored(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """model, path and content of every entry of the packages that are imported; none of any other."""
    checked = entries(files, manifest)
    whole = checked.join(imports(checked).filter("ok").select("model"), "model")
    content = files.select(F.col("path").alias("found"), "content")
    return whole.select("model", "path", "found").join(content, "found").select("model", "path", "content")


def provisioned(kept: DataFrame, manifest: DataFrame) -> DataFrame:
    """model and whether every entry of its manifest is among the stored files."""
    have = kept.select("model", "path").distinct().withColumn("here", F.lit(True))
    return manifest.join(have, ["model", "path"], "left").groupBy("model").agg(F.bool_and(F.coalesce("here", F.lit(False))).alias("provisioned"))
