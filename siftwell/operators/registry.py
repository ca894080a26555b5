"""Registries of named entries, and reproducible splits of their rows."""

from __future__ import annotations

import ast
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators.quantiles import at_ranks

SHARES = {"train": 0.8, "val": 0.1, "test": 0.1}


def kind_of(tree: ast.Module) -> str:
    """What a snippet defines at its top level. The names are fixed values."""
    functions = any(isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef) for n in tree.body)
    classes = any(isinstance(n, ast.ClassDef) for n in tree.body)
    return "mixed" if functions and classes else "function" if functions else "class" if classes else "code"


def exports_of(tree: ast.Module) -> list[str]:
    out: list[str] = []
    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            out.append(node.name)
        else:
            targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
            out += [t.id for t in targets if isinstance(t, ast.Name)]
    return out


def snippets(spark: SparkSession, folder: str) -> DataFrame:
    """(name, relpath, kind, exports, error) of the .txt files of a folder and those below; code is parsed, never run.

    error: why an entry can't be registered (it doesn't parse, or defines several functions), else null.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder)
    base = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/") + "/"

    def look(batches):
        for batch in batches:
            rows = []
            for path, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rel = path.split(base, 1)[-1]
                kind, exports, error = None, "", None
                try:
                    tree = ast.parse(data.decode("utf-8"))
                    kind, exports = kind_of(tree), ",".join(exports_of(tree))
                    if sum(isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef) for n in tree.body) > 1:
                        error = "several functions"
                except (SyntaxError, ValueError) as e:
                    error = f"{type(e).__name__}: {e}"
                rows.append((rel[:-4].replace("/", "."), rel, kind, exports, error))
            names = ("name", "relpath", "kind", "exports", "error")
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(5)], names=list(names))

    return files.select("path", "content").mapInArrow(look, "name string, relpath string, kind string, exports string, error string")


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """current with the rows of incoming put in: of the rows of a key those of incoming win, then the greatest in ``order``.

    Both have the same columns.  One partial aggregate by key; no window, so a hot key is combined before the shuffle.
    """
    rest = [c for c in current.columns if c not in keys]
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_new", *order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*current.columns)


def seeded_split(df: DataFrame, key: str, shares: Mapping[str, float] = SHARES, seed: int = 42) -> DataFrame:
    """df with a column split: rows ordered by a seeded hash of the key, cut into shares of exact size (the last takes the rest).

    The cuts are selected by rank in counting passes, so nothing is sorted; rows of one key fall together.
    """
    code = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("double")
    n, names = df.count(), list(shares)
    ends, total = [], 0
    for name in names[:-1]:
        total += int(shares[name] * n)
        ends.append(total)
    inside = [e for e in ends if e < n]
    cuts = dict(zip(inside, at_ranks(df, [(code, inside)])[0], strict=True)) if inside else {}
    split = F.lit(names[-1])
    for name, end in reversed(list(zip(names, ends, strict=False))):
        split = F.when(code < cuts[end], name).otherwise(split) if end in cuts else F.lit(name)
    return df.withColumn("split", split)
