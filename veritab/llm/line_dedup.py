"""Line dedup by distinct-site spread: HyperLogLog sketches, then exact counts.

A line is boilerplate when it stands on at least ``min_sites`` distinct sites.
Every line hash gets a HyperLogLog sketch of the sites it stands on; sketches merge by
partial aggregation, so a line on a third of all rows costs one sketch a
task. Estimates far from the threshold decide at once; lines near it get an
exact distinct count. Boilerplate lines then go from every document, wherever they stand.

Copies of a document say nothing about its lines: equal texts count once, on the least of their
sites, so that a text found on many sites isn't taken for boilerplate itself. A caller that knows copies by
better evidence passes ``counted``, the documents that stand for all (one of each group of copies), and only
their sites count. No document is exempt from removal.

Lines are cut at \\n and compared without white space at their ends; a blank line is never boilerplate.
``min_words`` may exempt lines of fewer words; by default it exempts none.

Defined results: null text stays null, empty text stays empty; a null site counts as
one site of its own. Repeated rows are independent rows. An empty table gives an
empty result. All columns of the input are kept, the text column is rewritten.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from veritab.llm.common import staged, tidied

#: log2 of the registers of a sketch: a standard error of about 1.6 %.
PRECISION = 12
#: Estimates from threshold / NEAR to threshold * NEAR are counted exactly: over 20 standard errors.
NEAR = 1.5
#: Line hashes up to this many are sent to every task; more are joined.
SMALL = 200_000


#: White space that is cut from the ends of a line.
BLANK = " \t\n\x0b\f\r"


def _stripped(line: F.Column) -> F.Column:
    return F.btrim(line, F.lit(BLANK))


def _lines(text: str) -> F.Column:
    return F.split(F.col(text), "\n", -1)


def sites_of(docs: DataFrame, site_col: str = "source", text_col: str = "text") -> DataFrame:
    """(site, text) of each row that has a text; equal texts share the least of their sites.

    Only the digests of texts on several sites are joined, so no text is shuffled while they are few.
    """
    rows = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(site_col).cast("string"), F.lit("\x00")).alias("site"), F.col(text_col).alias("text"))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    spread = rows.groupBy(digest.alias("digest")).agg(F.min("site").alias("least"), F.max("site").alias("most")).where("least < most")
    spread = staged(spread.select("digest", "least"), "copies")
    if spread.count() <= SMALL:
        spread = F.broadcast(spread)
    return rows.withColumn("digest", digest).join(spread, "digest", "left").select(F.coalesce("least", "site").alias("site"), "text")


def boilerplate(rows: DataFrame, min_sites: int = 5, min_words: int = 1) -> DataFrame:
    """(hash) of each line on at least min_sites sites. rows: (site, text)."""
    line = _stripped(F.col("line"))
    lines = rows.select("site", F.explode(_lines("text")).alias("line"))
    lines = lines.where(line.rlike(rf"^(?:\S+\s+){{{min_words - 1}}}\S")).select(F.xxhash64(line).alias("hash"), "site")
    spread = lines.groupBy("hash").agg(F.hll_sketch_agg("site", PRECISION).alias("sketch"))
    spread = spread.select("hash", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") * NEAR >= min_sites)
    spread = staged(spread, "spread")
    near = spread.where(F.col("sites") < min_sites * NEAR).select("hash")
    if near.count() <= SMALL:
        near = F.broadcast(near)
    exact = lines.join(near, "hash", "left_semi").groupBy("hash").agg(F.count_distinct("site").alias("sites"))
    sure = spread.where(F.col("sites") >= min_sites * NEAR).select("hash")
    return sure.union(exact.where(F.col("sites") >= min_sites).select("hash"))


def remove_boilerplate(docs: DataFrame, min_sites: int = 5, min_words: int = 1, site_col: str = "source", text_col: str = "text", counted: DataFrame | None = None, count_col: str | None = None) -> DataFrame:
    """docs with its boilerplate lines removed from the text, and every other column as it was.

    Sites are counted over ``counted``, or else over docs with equal texts on one site. ``count_col``
    names a further column with the number of lines removed (0 for null text).
    """
    rows = sites_of(docs, site_col, text_col) if counted is None else counted.select(F.coalesce(F.col(site_col).cast("string"), F.lit("\x00")).alias("site"), F.col(text_col).alias("text"))
    bad = staged(boilerplate(rows, min_sites, min_words), "boilerplate")
    schema = StructType([*docs.schema.fields, *([StructField(count_col, LongType())] if count_col else [])])
    at = docs.columns.index(text_col)
    if bad.count() <= SMALL:
        # A bounded set of hashes, which each task looks lines up in.
        known = docs.sparkSession.sparkContext.broadcast(frozenset(r.hash for r in bad.toLocalIterator()))
        return docs.mapInArrow(tidied(_remover(at, known, False, schema.names)), schema)
    # The verdict on a text depends on the text alone, so it is joined by the text's digest.
    text_hash = F.sha2(F.col(text_col).cast("binary"), 256)
    own = docs.select(text_hash.alias("__text"), F.explode(F.array_distinct(F.transform(_lines(text_col), lambda x: F.xxhash64(_stripped(x))))).alias("hash")).distinct()
    per_text = own.join(bad, "hash", "left_semi").groupBy("__text").agg(F.collect_set("hash").alias("__bad"))
    marked = docs.withColumn("__text", text_hash).join(per_text, "__text", "left").drop("__text")
    return marked.mapInArrow(tidied(_remover(at, None, True, schema.names)), schema)


def _remover(at: int, known, listed: bool, names: list[str]):
    """A task that rewrites column ``at``; hashes come from ``known`` or, with ``listed``, from the last column of each row.

    With a name more than columns the last one is the number of lines removed.
    """

    def rewritten(text: str, bad) -> tuple[str, int]:
        lines = text.split("\n")
        kept = [x for x in lines if (h := xxhash.xxh64_intdigest(x.strip(BLANK).encode("utf-8", "surrogatepass"), 42)) - (h >> 63 << 64) not in bad]
        return (text if len(kept) == len(lines) else "\n".join(kept)), len(lines) - len(kept)

    def run(batches):
        for b in batches:
            columns = b.columns[:-1] if listed else b.columns
            own = (frozenset(x or ()) for x in b.column(b.num_columns - 1).to_pylist()) if listed else (known.value for _ in range(b.num_rows))
            done = [(None, 0) if t is None else rewritten(t, bad) for t, bad in zip(b.column(at).to_pylist(), own, strict=True)]
            columns[at] = pa.array([t for t, _ in done], columns[at].type)
            if len(names) > len(columns):
                columns.append(pa.array([n for _, n in done], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return run
