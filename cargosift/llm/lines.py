"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only.

Two lines within max_edits edits share one of the shorter line's max_edits + 1 even segments, at a place in
the longer line that the lengths and the segment's number bound (multi-match-aware selection). Every distinct
line makes one key for each segment and admissible place and length; lines that meet in a key, one of them
with its own segment, are candidates. A 64-bit parity sketch of character pairs, which an edit changes in four
bits at most, rejects most of them inside the join, and a banded bit-parallel edit distance decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, drop_stored, fresh, stored


def split_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (row, doc_id, line_no, line): every line of every text; row tells rows of unlike id or text apart."""
    own = docs.where(F.col(text).isNotNull()).select(F.xxhash64(F.col(id_col), F.col(text)).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    return own


def _segment(i: int, parts: int, size: Column) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i of an even partition; the later segments are the longer ones."""
    base, extra = F.floor(size / parts).cast("int"), size % parts
    short = parts - extra
    length = base + F.when(F.lit(i) >= short, 1).otherwise(0)
    return (base * i + F.greatest(F.lit(0), F.lit(i) - short) + 1).cast("int"), length.cast("int")


def segment_keys(line: Column, size: Column, max_edits: int) -> list[tuple[Column, bool]]:
    """Keys of a line, each with whether it is the line's own segment; null where there is no such key."""
    parts, out = max_edits + 1, []
    for delta in range(max_edits + 1):
        target = size - delta
        for i in range(parts):
            start, length = _segment(i, parts, target)
            for shift in range(max(-i, delta - (max_edits - i)), min(i, delta + (max_edits - i)) + 1):
                at = start + shift
                key = F.xxhash64(F.lit(i), target, F.substring(line, at, length))
                ok = (target >= parts) & (at >= 1) & (at + length - 1 <= size)
                out.append((F.when(ok, key), delta == 0 and shift == 0))
    return out


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def pair_sketch(line: Column) -> Column:
    """Parity of the hashes of a line's pairs of neighbouring characters, in 64 bits."""
    chars = F.split(line, "")
    pairs = F.zip_with(chars, F.slice(chars, 2, 1 << 30), lambda a, b: F.xxhash64(a, b))
    one = F.lit(1).cast("long")
    bits = F.transform(F.filter(pairs, lambda h: h.isNotNull()), lambda h: F.call_function("shiftleft", one, F.pmod(h, F.lit(64)).cast("int")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))


def edit_distance(a: Column, b: Column, band: int) -> Column:
    """Edit distance of two arrays of characters if it is at most band, else a greater number or null.

    Bit-parallel over the 2 * band + 1 diagonals around the main one: each character of b updates the vertical
    differences of the band's column as bit vectors, and the diagonal that ends in the last cell adds up.
    """
    width = 2 * band + 1
    mask = (1 << width) - 1
    full = F.lit(mask).cast("long")
    no = lambda x: x.bitwiseXOR(full).bitwiseAND(full)
    off = F.size(a) - F.size(b)

    def step(acc: Column, j: Column) -> Column:
        c = F.get(b, j - 1)
        match = sum((F.when(F.get(a, j - band + i - 1) == c, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(1, width)), F.when(F.get(a, j - band - 1) == c, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
        vp, vn, total = acc["vp"], acc["vn"], acc["total"]

        def diagonal(pm: Column) -> Column:
            return (pm.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(full)

        def after(d0: Column) -> Column:
            hp = vn.bitwiseOR(no(d0.bitwiseOR(vp)))
            hn = d0.bitwiseAND(vp)
            down = F.shiftright(d0, 1)
            missed = F.when(j > F.greatest(F.lit(0), -off), 1 - F.shiftright(d0, band).bitwiseAND(1)).otherwise(0)
            near = F.when(off == 0, missed)
            for o in range(1, band + 1):
                for side in (o, -o):
                    near = near.when(off == side, F.when(j > F.greatest(F.lit(0), -off), 1 - F.shiftright(d0, band + side).bitwiseAND(1)).otherwise(0))
            return F.struct(hn.bitwiseOR(no(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (total + near).cast("long").alias("total"))

        return _let(match, lambda pm: _let(diagonal(pm), after))

    start = F.struct(F.lit(mask & ~((1 << band) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.abs(off).cast("long").alias("total"))
    return F.when(F.size(b) == 0, F.size(a).cast("long")).otherwise(F.aggregate(F.sequence(F.lit(1), F.size(b)), start, step, lambda acc: acc["total"]))


def edit_links(lines: DataFrame, max_edits: int = 2) -> DataFrame:
    """Links (a, b, edits), a < b, between keys k of distinct lines (k, line) whose texts are within max_edits edits."""
    size = F.length("line")
    keys = segment_keys(F.col("line"), size, max_edits)
    # Copies of a line fold into one row before anything is dealt out; equal k have equal keys.
    folded = lines.select("k", *[x.alias(f"s{n}") for n, (x, _) in enumerate(keys)]).groupBy("k").agg(*[F.min(f"s{n}").alias(f"s{n}") for n in range(len(keys))])
    rows = folded.select("k", F.explode(F.array(*[F.struct(F.col(f"s{n}").alias("key"), F.lit(own).alias("own")) for n, (_, own) in enumerate(keys)])).alias("e")).select("k", "e.key", "e.own").where("key is not null")
    w = Window.partitionBy("key").orderBy("k")
    marked = rows.select("k", "key", "own", F.lag("k").over(w).alias("before"), F.lead("k").over(w).alias("after"))
    met = stored(marked.where("before <> k or after <> k").select("k", "key", "own"), "lines-m")
    texts = lines.select("k", "line").join(met.select("k").distinct(), "k", "left_semi").dropDuplicates(["k"])
    texts = stored(texts.select("k", F.split("line", "").alias("chars"), pair_sketch(F.col("line")).alias("sketch")), "lines-t")
    sketched = stored(met.join(texts.select("k", "sketch"), "k"), "lines-s")
    probe, own = sketched.select(F.col("k").alias("a"), "key", F.col("sketch").alias("x")), sketched.where("own").select(F.col("k").alias("b"), "key", F.col("sketch").alias("y"))
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= 4 * max_edits
    pairs = probe.join(own, (probe["key"] == own["key"]) & (F.col("a") != F.col("b")) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, right = texts.select(F.col("k").alias("a"), F.col("chars").alias("p")), texts.select(F.col("k").alias("b"), F.col("chars").alias("q"))
    both = pairs.join(left, "a").join(right, "b").where(F.abs(F.size("p") - F.size("q")) <= max_edits)
    return both.select("a", "b", edit_distance(F.col("p"), F.col("q"), max_edits).alias("edits")).where(F.col("edits") <= max_edits)


def repeated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_edits: int = 2, min_chars: int = 20, short_copies: bool = False) -> DataFrame:
    """Rows (doc_id, row, line_no, class_doc_id, class_line_no, n_copies, n_links, removed): lines that occur again.

    Lines of at least min_chars characters that are equal or within max_edits edits of one another, directly
    or over others, are a class; the class is named by its first line in order of (doc_id, line_no), which
    alone stays (removed is false). n_copies counts the line's equal lines, itself included, n_links the other
    line texts within max_edits. Only classes of two lines or more are returned. With short_copies shorter lines take
    part as exact copies, unless blank; without it they take no part, nor do null texts. Repeated rows of one id and text count as one row. Lines are told apart by a 64-bit hash.
    """
    long = F.length("line") >= min_chars  # two edits of a shorter line may make another word of it
    every = split_lines(docs, id_col, text).where(long | F.col("line").rlike(r"\S") if short_copies else long).withColumn("k", F.xxhash64("line"))
    links = stored(edit_links(every.where(long).select("k", "line"), max_edits), "lines-l")
    comp = stored(components(links.select("a", "b")), "lines-c")
    places = every.select("k", "row", "doc_id", "line_no").distinct()
    degree = links.select(F.explode(F.array("a", "b")).alias("k")).groupBy("k").agg(F.count("*").alias("n_links"))
    where = F.struct("doc_id", "line_no", "row")
    per = places.groupBy("k").agg(F.min(where).alias("first"), F.count("*").alias("n_copies"))
    named = per.join(comp.withColumnRenamed("node", "k"), "k", "left").join(degree, "k", "left").withColumn("class", F.coalesce("component", "k"))
    whole = named.groupBy("class").agg(F.min("first").alias("lead"), F.sum("n_copies").alias("n")).where("n > 1")
    # Written, so that the join to all places knows its size, and can split a line that very many of them hold.
    known = stored(named.join(whole, "class").select("k", "lead", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")), "lines-k")
    drop_stored(links, comp)
    out = places.join(known, "k")
    first = (F.col("row") == F.col("lead.row")) & (F.col("line_no") == F.col("lead.line_no"))
    return out.select("doc_id", "row", "line_no", F.col("lead.doc_id").alias("class_doc_id"), F.col("lead.line_no").alias("class_line_no"), "n_copies", "n_links", (~first).alias("removed"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_edits: int = 2, min_chars: int = 20, short_copies: bool = False) -> DataFrame:
    """docs with repeated lines cut from their texts; every row stays, with its other columns, of any name, as they were.

    Null texts stay null and texts without a repeat as they are, also empty ones; of repeated rows of one id and text each loses the same lines.
    """
    row, cut = fresh(docs, "_row"), fresh(docs, "_gone")
    gone = repeated(docs, id_col, text, max_edits, min_chars, short_copies).where("removed").groupBy("row").agg(F.collect_set("line_no").alias(cut))
    keyed = docs.withColumn(row, F.xxhash64(F.col(id_col), F.col(text)))
    joined = keyed.join(gone.withColumnRenamed("row", row), row, "left")
    lines = F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(F.col(cut), i))
    return joined.withColumn(text, F.when(F.col(cut).isNull(), F.col(text)).otherwise(F.array_join(lines, "\n"))).select(*docs.columns)
