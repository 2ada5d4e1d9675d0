"""Document fingerprints by SpotSigs; DataFrame operations only.

Wherever a common word (an anchor) stands, it and the next content words make one signature: what
prose is about, without the tables and menus around it. A document's fingerprint is the set of its
signatures. Sets are compared by Jaccard; their sizes alone bound it, so documents are partitioned
by size, and sets are only intersected where the bound allows what is asked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollmark.llm.common import prepare

#: Anchors: common words of English, German, French and Spanish. Fixed values.
ANCHORS = (
    "the of and to in is that it for on with as was are be at by this have or "
    "der die das und ist den im mit ein eine zu auf von nicht es dem des "
    "le la les un une et est dans que qui pour sur au du en pas "
    "el los las una y por con del se su lo no"
).split()
#: Content words in a signature.
CHAIN = 2
#: Where no anchor stands among so many words, the words after them are anchors too, until the next anchor.
STRETCH = 8
SIMILARITY = 0.8
#: Bytes of text in a cell of neighbouring ids, and cells at most.
CELL_BYTES = 4 << 20
CELLS = 1 << 16
_FAN = 256
NO_ID = -(1 << 63)


def with_signatures(df: DataFrame, text: str, name: str, chain: int = CHAIN) -> DataFrame:
    """Add ``name``: the set of signatures (hashes, ascending) of the column ``text``, which has no nulls.

    A signature is an anchor with the next ``chain`` words that are no anchors. Lists and tables have
    hardly any anchors: after ``STRETCH`` words without one each word is taken as an anchor for the
    words after it, up to the next real one. A text with no signature by that takes every word as an
    anchor; one without words, but not empty, is one signature of its own; an empty one has none.
    """
    words, content, places, found = f"{name}_words", f"{name}_content", f"{name}_places", f"{name}_found"
    # step by step, so that no step is computed twice
    df = df.withColumn(words, F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    df = df.withColumn(content, F.filter(words, lambda w: ~w.isin(ANCHORS)))
    df = df.withColumn(places, F.filter(F.transform(words, lambda w, i: F.when(w.isin(ANCHORS), i).otherwise(-1)), lambda i: i >= 0))

    def chained(first: Column, at: Column, size: int) -> Column:
        """Hash of ``first`` and the content words from number ``at`` on; null if there are too few."""
        return F.when(at + size <= F.size(content), F.xxhash64(*([first] if first is not None else []), *(F.get(content, at + j) for j in range(size))))

    # k anchors stand before the k-th anchor at place p, so the content after it starts with number p - k
    anchored = F.transform(places, lambda p, k: chained(F.get(words, p), p - k, chain))

    def stretch(p: Column, k: Column) -> Column:
        """Signatures between the k-th anchor, at place p (the first one is the start), and the next."""
        stop = F.coalesce(F.get(places, k), F.size(words))
        begin = p + 1 + STRETCH
        return F.when(stop > begin, F.transform(F.sequence(begin, stop - 1), lambda i: chained(None, i - k, chain + 1)))

    between = F.flatten(F.array_compact(F.transform(F.concat(F.array(F.lit(-1)), F.col(places)), stretch)))
    df = df.withColumn(found, F.array_distinct(F.array_compact(F.concat(anchored, between))))
    plain = F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(words, i + 1 + j) for j in range(chain))))
    raw = F.when(F.col(text) == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(text)))
    chosen = F.when(F.size(found) > 0, F.col(found)).when(F.size(words) > 0, F.array_distinct(plain)).otherwise(raw)
    return df.withColumn(name, F.array_sort(chosen)).drop(words, content, places, found)


def fingerprint(signatures: Column) -> Column:
    """A set of signatures as 32 hex digits; equal sets, and so equal texts, have equal ones."""
    halves = (F.xxhash64(signatures), F.xxhash64(F.lit(1), signatures))
    return F.concat(*(F.lower(F.lpad(F.hex(h), 16, "0")) for h in halves))


def size_partition(signatures: Column, least: float = SIMILARITY) -> Column:
    """Number of the partition by set size: sets that are ``least`` alike are in the same or neighbouring ones."""
    return F.when(F.size(signatures) == 0, -1).otherwise(F.floor(F.log(F.size(signatures).cast("double")) / -math.log(least) + 1e-9)).cast("int")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two sets; 0 without comparing them where their sizes keep it below ``least``. Two empty sets are alike."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    return (
        F.when(large == 0, 1.0)
        .when((small == 0) | (small < least * large), 0.0)
        .otherwise(shared / (F.size(a) + F.size(b) - shared))
    )


def _number_of_cell(bounds: list[int]) -> Column:
    """How many of the sorted bounds are at or below ``id``: looked up in two steps."""
    if not bounds:
        return F.lit(0)

    def table(values: list[int]) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= F.col("id")))

    groups = [bounds[i : i + _FAN] for i in range(0, len(bounds), _FAN)]
    if len(groups) == 1:
        return below(table(bounds))
    nested = F.transform(F.split(F.lit(";".join(",".join(map(str, g)) for g in groups)), ";"), lambda g: F.split(g, ",").cast("array<bigint>"))
    group = below(table([g[0] for g in groups]))
    return F.when(group == 0, 0).otherwise((group - 1) * _FAN + below(F.get(nested, group - 1)))


def with_next(docs: DataFrame, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """``doc_id, text, signatures`` and the next document's ``next_text, next_signatures``.

    The next document is the one with the next smaller id, after the last the first; equal ids follow
    each other in the order of their texts, and null ids come last. Documents are cut into cells of
    neighbouring ids; the first document of each cell is copied into the cell before it.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = min(CELLS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // cell_bytes)))
    shares = [k / cells for k in range(1, cells)]
    bounds = source.agg(F.percentile_approx("id", shares, max(10_000, 10 * cells))).first()[0] if shares else []
    cell = _number_of_cell(sorted(set(bounds or [])))
    # one row for each cell, of which there are at most CELLS
    firsts = sorted(source.select("id", cell.cast("int").alias("cell")).groupBy("cell").agg(F.max("id").alias("id")).collect(), key=lambda r: -r["cell"])
    guests = [(first["id"], before["cell"]) for first, before in zip(firsts, firsts[-1:] + firsts[:-1], strict=True)]
    listed = F.broadcast(
        spark.range(1)
        .select(F.explode(F.split(F.lit(";".join(f"{i},{c}" for i, c in guests)), ";")).alias("x"))
        .select(F.split_part("x", F.lit(","), F.lit(1)).cast("long").alias("id"), F.split_part("x", F.lit(","), F.lit(2)).cast("int").alias("visited"))
        if guests
        else spark.range(0).select("id", F.lit(0).alias("visited"))
    )
    placed = source.withColumn("cell", cell.cast("int")).join(listed, "id", "left")
    visits = F.array_compact(F.array(F.struct("cell", F.lit(0).alias("guest")), F.when(F.col("visited").isNotNull(), F.struct(F.col("visited").alias("cell"), F.lit(1).alias("guest")))))
    placed = placed.select("doc_id", "id", "text", F.explode(visits).alias("v")).select("doc_id", "id", "text", "v.cell", "v.guest")
    placed = with_signatures(placed.repartition("cell"), "text", "signatures")
    order = Window.partitionBy("cell").orderBy("guest", F.desc("id"), "text")
    placed = placed.withColumns({"next_text": F.lead("text").over(order), "next_signatures": F.lead("signatures").over(order)})
    return placed.filter("guest = 0").select("doc_id", "text", "signatures", "next_text", "next_signatures")


def edited_fingerprints(docs: DataFrame, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """Fingerprint every text and its edited version, and compare them.

    The edited text has its last third of code points (rounded down) replaced by as many first ones of
    the next document, or all it has. Returns ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, n_signatures, size_partition``. A null text is empty;
    null and repeated ids keep their rows. A single document is its own next. An empty table gives an
    empty result.
    """
    prepare(docs.sparkSession)
    rows = with_next(docs, cell_bytes).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - third), F.substring(F.col("next_text"), F.lit(1), third))
    rows = rows.withColumn("edited", edited).drop("text", "next_text")
    rows = with_signatures(rows, "edited", "edited_signatures")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("signatures")).alias("fingerprint"),
        fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
        F.size("signatures").alias("n_signatures"),
        size_partition(F.col("signatures")).alias("size_partition"),
    )
