"""Line dedup within one edit, by a deletion-neighbourhood join; DataFrame functions only.

A line goes if an earlier line, by document id and line number, is within one inserted, deleted or replaced
character of it. Equal lines are found first; what follows is over distinct lines.

Two lines are within one edit if deleting one character from one or both leaves the same text. All such
variants of all lines would be as many as there are characters, so they are emitted in two steps:

1. The deleted character lies in one of ``BLOCKS`` stretches of the line. With a stretch deleted as a whole,
   both lines leave the same prefix and suffix; their hash is the key. Each line emits the keys for partners
   of its own length and for shorter ones. A (line, stretch) whose key no other line has can have no partner
   there. Of long lines, the stretches that are left are cut into ``CUT`` parts and looked at in the same way, until none has more than ``LONG``
   characters; each look costs the line's length, and there are as many as its length has digits.
2. Only for the others every character of the stretch is deleted in turn. The variant's key is the hash of what is left of the stretch and of
   the hashes of what stands before and after it, so a variant costs the stretch, not the line.
   Same-length lines that agree but for one place are all within one edit of each other, and a line is within
   one edit of all its own deletions. So the smallest position of a key is a partner of all its lines, and
   only that link is followed: no pairs inside a group are made.

Links are verified with the edit distance of the two texts (of long ones, by what stands behind the first difference), which also guards against equal hashes. Keys'
minima are pre-aggregated per task, and lines that repeat are one row before any key is made, so no
frequent line meets itself.

Defined results. Lines are what lies between line feeds, numbered from 0. Null texts have one empty line. Empty
lines are kept and are no one's copy. Null ids count as later than all others. Rows that repeat an id are documents of
their own, in the order in which they are read, so of their equal lines one is kept. Very long lines are compared
whole. Ids are of any type that has an order; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import forget, salted, text_of, written

BLOCKS = 3
#: Stretches of more characters are cut into so many parts before single characters are deleted.
LONG, CUT = 171, 8
_STEP = 10_000_000_000
_LAST = (1 << 63) - 1


def _position(id_col: str, line: str) -> Column:
    """One ordered number for document and line."""
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).cast("decimal(19,0)")
    return (doc * F.lit(_STEP).cast("decimal(11,0)") + F.col(line)).cast("decimal(38,0)")


def _digest(line: str) -> Column:
    return F.unhex(F.md5(F.col(line).cast("binary")))


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line_no, line."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_of(text_col), "\n", -1)).alias("line_no", "line"))


def _edges(j: Column, p: Column, blocks: Column) -> tuple[Column, Column]:
    """First character (from 0) of the j-th of so many stretches of p characters, and the first one after it."""
    return F.floor(j * p / blocks).cast("int"), F.floor((j + 1) * p / blocks).cast("int")


def _stretch_key(j: Column, p: Column, blocks: Column) -> Column:
    """Hash of a line of ``n`` characters without its j-th stretch, for partners of p characters."""
    s, e = _edges(j, p, blocks)
    rest = p - e
    return F.xxhash64(j, p, F.substring(F.col("line"), F.lit(1), s), F.substring(F.col("line"), F.col("n") - rest + 1, rest))


def _coarse() -> Column:
    """array<struct<key, spot>> of a line of ``n`` characters; spot packs the stretch and whether the partner is shorter."""
    out = []
    for shorter in (0, 1):
        p = F.col("n") - shorter
        blocks = F.least(F.lit(BLOCKS), p)
        for j in range(BLOCKS):
            out.append(F.when(blocks > j, F.struct(_stretch_key(F.lit(j), p, blocks).alias("key"), F.lit(2 * j + shorter).alias("spot"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def _partner() -> tuple[Column, Column, Column]:
    """Of a spot: the stretch, the partner's length, whether it is shorter."""
    shorter = F.col("spot") % 2
    return F.floor(F.col("spot") / 2).cast("int"), F.col("n") - shorter, shorter


def _blocks(p: Column, level: int) -> Column:
    """Into how many stretches a line is cut at a level; each one is those of the level before in ``CUT`` parts."""
    return F.least(F.lit(BLOCKS), p) * F.lit(CUT**level)


def _finer(level: int) -> Column:
    """As :func:`_coarse`, with the parts at this level of the stretch that a spot of the level before names."""
    j, p, shorter = _partner()
    blocks = _blocks(p, level)
    return F.transform(F.sequence(j * CUT, j * CUT + (CUT - 1)), lambda k: F.struct(_stretch_key(k, p, blocks).alias("key"), (k * 2 + shorter).cast("int").alias("spot")))


def _fine(level: int) -> Column:
    """array<struct<key, role>>: one character of the stretch deleted. role 0: partners of equal length; 1: a shorter one, to meet its role 2."""
    j, p, shorter = _partner()
    s, e = _edges(j, p, _blocks(p, level))
    size = e + shorter - s
    head, tail = F.substring(F.col("line"), F.lit(1), s), F.substring(F.col("line"), s + size + 1, F.col("n") - s - size)
    block = F.substring(F.col("line"), s + 1, size)
    # Bound once by the outer transform: a lambda's body is evaluated anew for each element.
    parts = F.array(F.struct(F.xxhash64(head).alias("head"), block.alias("block"), F.xxhash64(tail).alias("tail"), s.alias("s"), p.alias("p"), size.alias("size"), shorter.alias("shorter")))

    def key(x: Column, kind: Column, place: Column, rest: Column) -> Column:
        return F.xxhash64(kind, x["p"], place, x["head"], rest, x["tail"])

    def variants(x: Column) -> Column:
        gone = lambda i: F.concat(F.substring(x["block"], F.lit(1), i - 1), F.substring(x["block"], i + 1, x["size"] - i))
        place = lambda i: F.when(x["shorter"] == 0, x["s"] + i).otherwise(x["s"])
        deleted = F.transform(F.sequence(F.lit(1), x["size"]), lambda i: F.struct(key(x, x["shorter"], place(i), gone(i)).alias("key"), x["shorter"].alias("role")))
        whole = F.array(F.struct(key(x, F.lit(1), x["s"], x["block"]).alias("key"), F.lit(2).alias("role")))
        deleted = F.when(x["size"] > 0, deleted).otherwise(F.array().cast("array<struct<key: bigint, role: int>>"))
        return F.when(x["shorter"] == 0, F.concat(deleted, whole)).otherwise(deleted)

    return F.element_at(F.transform(parts, variants), 1)


def _likely(keys: DataFrame) -> DataFrame:
    """did, spot of the stretches (key, did, spot) whose key another line has too. Keys are dear to make and small: they are written once and read twice."""
    keys = written(keys, "keys")
    shared = keys.groupBy("key").agg(F.min("did").alias("lo"), F.max("did").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("key", "n")
    shared = written(shared, "shared")
    found = written(salted(keys, shared, "key", "n", "did").select("did", "spot").distinct(), "stretches")
    forget(keys)
    forget(shared)
    return found


def _exploded(lines: DataFrame, keys: Column, *more: str) -> DataFrame:
    return lines.select("did", *more, F.explode(keys).alias("x")).select("did", *more, "x.*")


def near_lines(distinct: DataFrame) -> DataFrame:
    """distinct (did, line, n, pos) -> did, near: the smallest earlier position within one edit."""
    texts = written(distinct.join(_likely(_exploded(distinct, _coarse())), "did"), "variants")
    _, p, _ = _partner()
    fine, now, level = None, texts, 0
    while True:
        # A stretch has its share of the line's characters, or one more.
        short = F.ceil(p / _blocks(p, level)) <= LONG
        part = _exploded(now.where(short), _fine(level), "pos")
        fine = part if fine is None else fine.unionByName(part)
        rest = now.where(~short)
        if not rest.limit(1).count():
            break
        level += 1
        now = written(distinct.join(_likely(_exploded(rest, _finer(level))), "did"), "variants")
    least = lambda role: F.min(F.when(F.col("role") == role, F.col("pos")))
    best = fine.groupBy("key").agg(least(0).alias("p0"), least(1).alias("p1"), least(2).alias("p2"), F.min("did").alias("lo"), F.max("did").alias("hi")).where("lo <> hi").drop("lo", "hi")
    partner = F.when(F.col("role") == 0, F.col("p0")).when(F.col("role") == 1, F.col("p2")).otherwise(F.col("p1"))
    links = fine.join(best, "key").select("did", "pos", partner.alias("near")).where("near < pos").select("did", "near").distinct()
    links = written(links, "links")
    own = texts.select("did", "pos", "line").distinct()
    other = own.select(F.col("pos").alias("near"), F.col("line").alias("near_line"))
    both = links.join(own.select("did", "line"), "did").join(other, "near")
    return both.where(within_one("line", "near_line")).groupBy("did").agg(F.min("near").alias("near"))


def within_one(a: str, b: str) -> Column:
    """Whether two different texts (SQL names) are one edit apart.

    For long ones, whose edit distance takes the square of their length here, the first place that differs is found by halving: the
    rest must be equal behind it.
    """
    bound = f"least(length({a}), length({b}))"
    halved = f"""aggregate(sequence(0, cast(ceil(log2({bound} + 1)) AS int)), named_struct('lo', 0, 'hi', {bound}), (x, _) ->
        if(x.lo < x.hi, if(left({a}, (x.lo + x.hi + 1) div 2) = left({b}, (x.lo + x.hi + 1) div 2), named_struct('lo', cast((x.lo + x.hi + 1) div 2 AS int), 'hi', x.hi), named_struct('lo', x.lo, 'hi', cast((x.lo + x.hi + 1) div 2 - 1 AS int))), x), x -> x.lo)"""
    rest = lambda t, k: f"substring({t}, {k})"
    behind = f"""transform(array({halved}), k -> CASE length({a}) - length({b}) WHEN 0 THEN {rest(a, 'k + 2')} = {rest(b, 'k + 2')} WHEN 1 THEN {rest(a, 'k + 2')} = {rest(b, 'k + 1')} WHEN -1 THEN {rest(a, 'k + 1')} = {rest(b, 'k + 2')} ELSE false END)[0]"""
    return F.expr(f"if(greatest(length({a}), length({b})) <= {LONG * BLOCKS}, levenshtein({a}, {b}, 1) = 1, {behind})")


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Documents as id (long, in the order of the given ids, different for every row) and text; and, unless they are the given ids, num and name.

    Integer ids that don't repeat are their own numbers. Others are put in order once: a sort of ids, not of texts.
    """
    rows = docs.select(F.col(id_col).alias("name"), text_of(text_col).alias("text"))
    whole = dict(rows.dtypes)["name"] in ("bigint", "int", "smallint", "tinyint")
    if whole and not rows.groupBy("name").count().where("count > 1").limit(1).count():
        return rows.select(F.col("name").cast("long").alias("id"), "text"), None
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    order = rows.select("name", "row").orderBy(F.col("name").asc_nulls_last(), "row")
    names = written(order.select("name", "row", F.monotonically_increasing_id().alias("num")), "numbers")
    return rows.join(names.select("row", F.col("num").alias("id")), "row").select("id", "text"), names.select("num", "name")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: id, line_no, kept, keep_id and keep_line_no of the earliest line it copies (its own if kept), distance."""
    narrow, names = _numbered(docs, id_col, text_col)
    out = _line_dedup(narrow)
    if names is None:
        return out
    own, other = (names.select(F.col("num").alias(n), F.col("name").alias(f"{n}_name")) for n in ("id", "keep_id"))
    named = out.join(own, "id").join(other, "keep_id")
    return named.select(F.col("id_name").alias("id"), "line_no", "kept", F.col("keep_id_name").alias("keep_id"), "keep_line_no", "distance")


def _line_dedup(narrow: DataFrame) -> DataFrame:
    all_lines = lines_of(narrow, "id", "text")
    full = all_lines.where("line <> ''").withColumn("pos", _position("id", "line_no"))
    distinct = full.groupBy("line").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("rows"))
    distinct = written(distinct.select(F.monotonically_increasing_id().alias("did"), "line", F.length("line").alias("n"), "pos", "rows", _digest("line").alias("digest")), "lines")
    near = written(near_lines(distinct.select("did", "line", "n", "pos")), "near")
    first = distinct.select("did", "digest", "rows", F.col("pos").alias("first")).join(near, "did", "left").drop("did")
    out = salted(full.select("id", "line_no", "pos", _digest("line").alias("digest")), first, "digest", "rows", "pos", distinct)
    keep = F.coalesce("near", "first")
    line_no = F.pmod(keep, F.lit(_STEP).cast("decimal(11,0)"))
    doc = ((keep - line_no) / F.lit(_STEP)).cast("long")
    out = out.select(
        "id",
        "line_no",
        (keep == F.col("pos")).alias("kept"),
        F.when(doc != _LAST, doc).alias("keep_id"),
        line_no.cast("int").alias("keep_line_no"),
        F.when(F.col("near").isNotNull(), 1).otherwise(0).alias("distance"),
    )
    empty = all_lines.where("line = ''").select("id", "line_no", F.lit(True).alias("kept"), F.col("id").alias("keep_id"), F.col("line_no").alias("keep_line_no"), F.lit(0).alias("distance"))
    return out.unionByName(empty)


def clean_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text: each document's lines that are kept, in order. Rows that repeat an id are documents of their own."""
    narrow, names = _numbered(docs, id_col, text_col)
    narrow = narrow.withColumn("id", F.coalesce("id", F.lit(_LAST)))
    found = _line_dedup(narrow).where("kept").groupBy("id").agg(F.collect_set("line_no").alias("keep"))
    own = narrow.select("id", F.split("text", "\n", -1).alias("lines"))
    joined = own.join(found, "id", "left").select("id", "lines", F.array_sort(F.coalesce("keep", F.array().cast("array<int>"))).alias("keep"))
    text = F.array_join(F.transform("keep", lambda i: F.element_at("lines", i + 1)), "\n")
    out = joined.select("id", text.alias("text"))
    if names is None:
        return out.withColumn("id", F.when(F.col("id") != _LAST, F.col("id")))
    return out.join(names, out["id"] == names["num"]).select(F.col("name").alias("id"), "text")
