"""Line dedup with DataFrame functions only.

Lines are exploded, normalised and hashed; a key that at least two documents
hold keeps its lines in the document of smallest id and loses them in all
others; what stays is put together by position.

The count of documents needs no distinct: a key's smallest and largest id
differ exactly if two documents hold it. Both are combined on the map side, so
a line that a third of all documents share is one row for each map task. The
join back is a plain equi-join, whose hot keys adaptive execution splits.

Defined results: a null or empty text is one empty line; keys shorter than
``min_chars`` code points never go; a row with a null id neither counts nor
loses lines; repeated rows of an id count once and each lose the same lines;
rows of one id with different texts count as one document, each losing its
own lines; other columns are ignored or, in :func:`deduplicated`, kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _store

#: What is stripped at both ends of a line.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each document row: id, a hash that tells rows of one id apart, and the lines."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("_id"),
        F.xxhash64(text).alias("_row"),
        F.split(text, "\n", -1).alias("_lines"),
    )


def _dropped(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(_id, _row, _gone): positions of the lines that a document row loses, where there are any."""
    lines = (
        _lines(docs, id_col, text_col)
        .where("_id is not null")
        .select("_id", "_row", F.posexplode("_lines").alias("_pos", "_line"))
        .select("_id", "_row", "_pos", key(F.col("_line")).alias("_key"))
        .where(F.char_length("_key") >= min_chars)
        .select("_id", "_row", "_pos", F.xxhash64("_key").alias("_h"), F.xxhash64(F.lit(1), "_key").alias("_g"))
    )
    shared = lines.groupBy("_h", "_g").agg(F.min("_id").alias("_owner"), F.max("_id").alias("_last")).where("_owner < _last")
    # kept, so that both sides of the join are plain shuffles, whose hot partitions adaptive execution splits
    shared = _store.kept(shared.select("_h", "_g", "_owner"))
    return (
        lines.join(shared, ["_h", "_g"])
        .where("_id <> _owner")
        .groupBy("_id", "_row")
        .agg(F.collect_set("_pos").alias("_gone"))
    )


def _kept() -> Column:
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    some = F.transform(F.array_except(every, F.col("_gone")), lambda i: F.element_at("_lines", i + 1))
    return F.array_join(F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(some), "\n")


def line_dedup(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): the text that is left of each row, with its line counts."""
    left = _lines(docs, id_col, text_col)
    return left.join(_dropped(docs, id_col, text_col, min_chars), ["_id", "_row"], "left").select(
        F.col("_id").alias("doc_id"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
        _kept().alias("kept"),
    )


def deduplicated(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The rows and columns of ``docs`` with the text that is left; ``length_col`` is set to its code points."""
    taken = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole = docs.select(
        taken,
        F.col(id_col).cast("long").alias("_id"),
        F.xxhash64(text).alias("_row"),
        F.split(text, "\n", -1).alias("_lines"),
    )
    # the text itself is not shuffled beside its lines
    whole = whole.withColumn("_all", F.col("_all").dropFields(text_col))
    left = whole.join(_dropped(docs, id_col, text_col, min_chars), ["_id", "_row"], "left").withColumn("_kept", _kept())
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.col("_kept").alias(c))
        elif c == length_col:
            out.append(F.char_length("_kept").cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col("_all").getField(c).alias(c))
    return left.select(*out)


ORACLE = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM e),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, o.owner IS NOT NULL AND k.doc_id <> o.owner AS dropped FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
