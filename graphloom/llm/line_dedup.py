"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line (spaces, tabs and carriage returns at its ends aside) goes if an equal line stands earlier: in
a smaller doc_id, or higher up in the same document.  A line of `near_chars` code points or more also
goes if another line within `edits` edits stands earlier; in shorter ones two edits make another
line.  Lines are judged on the input, not on what is left; blank lines stay.

Lines are split into edits + 1 even segments.  If two lines are within `edits` edits, one segment of
the shorter stands unchanged in the longer, near its own place; the places that must be probed for
each length difference follow from which segments may have been hit before and after it.  Keys at
which different lines meet are found by aggregation, and only their lines are looked at again.

Work on a key is in proportion to its lines, however many they are.  Each line is first verified
against the earliest line of each of its keys: a group of near copies is settled there.  Lines not
settled look for any earlier line of their keys in a semi-join, which gives at most one row a line.
Pairs whose letter counts differ by more than edits can make are passed over; verification is the
banded bit-parallel distance, whose 2 * edits + 1 bits hold the diagonals that matter; ends that two
lines share are cut off before it.

Nulls: a null text has no lines and stays null; a null doc_id sorts last and stays null.  Rows that
repeat id and text are one document: neither is earlier than the other.  Very long texts and lines
are taken whole.  An empty table gives an empty one; `drop_lines` keeps extra columns, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_KEY, doc_id_of, keyed_texts, staged

EDITS, NEAR_CHARS = 2, 20
#: Pieces of a line of which all but `edits` must stand in a near one.
PIECES = 8
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Keys or lines whose hashes may be broadcast (24 bytes each); beyond, they are shuffled.
BROADCAST_ROWS = 1_000_000


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def occurrences(texts: DataFrame) -> DataFrame:
    """(key, tid, line_no, line) of all lines that are not blank; tid tells texts of one id apart."""
    lines = texts.select("key", F.xxhash64("text").alias("tid"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.withColumn("line", trimmed(F.col("line"))).where(F.col("line") != "")


def places(edits: int) -> list[tuple[bool, int, int, int]]:
    """(probe, less, segment, shift): where an index key, or a probe for a line shorter by `less`, is cut out.

    At most `segment` edits before a segment and edits - segment after it need be tried: were it more,
    another segment would be unchanged too.
    """
    out = [(False, 0, i, 0) for i in range(edits + 1)]
    for less in range(edits + 1):
        for i in range(edits + 1):
            low, high = max(-i, less - (edits - i)), min(i, less + (edits - i))
            out += [(True, less, i, shift) for shift in range(low, high + 1)]
    return out


def keyed_lines(lines: DataFrame, edits: int) -> DataFrame:
    """(lid, probe, at): a row for each key of each line; at is the hash of segment number, length and substring."""
    each = F.array(*[F.struct(*(F.lit(v).alias(n) for n, v in zip(("probe", "less", "i", "shift"), place, strict=True))) for place in places(edits)])
    rows = lines.select("line", F.xxhash64("line").alias("lid"), F.char_length("line").alias("length")).select("*", F.inline(each))
    size = F.col("length") - F.col("less")
    edge = lambda i: F.floor(size * i / (edits + 1)).cast("int")
    piece = F.substring("line", edge(F.col("i")) + 1 + F.col("shift"), edge(F.col("i") + 1) - edge(F.col("i")))
    return rows.select("lid", "probe", F.xxhash64("i", size, piece).alias("at"))


def banded_distance(pattern: Column, text: Column, edits: int) -> Column:
    """Edit distance if it is at most `edits`, else some larger number, for lengths that differ by no more.

    Bit i of the words is the diagonal i - edits.  The value at the lowest diagonal is followed down to
    the pattern's end, then along its last row.  Characters come as arrays; the pattern is padded.
    """
    k, top = edits, 2 * edits
    pad = F.array_repeat(F.lit(""), k)
    # The arrays are bound once: inside a lambda they would be split again for every character.
    given = F.struct(F.concat(pad, F.split(pattern, ""), pad).alias("p"), F.split(text, "").alias("t"), F.char_length(pattern).alias("m"))
    return _once(given, lambda g: _distance(g["p"], g["t"], g["m"], k, top))


def _distance(p: Column, t: Column, m: Column, k: int, top: int) -> Column:
    every = (1 << (top + 1)) - 1
    first = F.struct(F.lit(every ^ ((1 << k) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(k).alias("d"))
    chars = F.transform(t, lambda c, j: F.struct(j.alias("j"), sum((F.when(F.get(p, j + i) == c, 1 << i).otherwise(0) for i in range(top + 1)), F.lit(0)).alias("eq")))

    def step(s: Column, c: Column) -> Column:
        x = F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"), (((c["eq"].bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])).bitwiseOR(c["eq"]).bitwiseOR(s["vn"])).bitwiseAND(F.lit(every)).alias("d0"))
        return _once(x, lambda x: _advance(x, c["j"]))

    def _advance(x: Column, j: Column) -> Column:
        hp = x["vn"].bitwiseOR(F.lit(every).bitwiseXOR(x["d0"].bitwiseOR(x["vp"])))
        hn = x["d0"].bitwiseAND(x["vp"])
        y = F.struct(x["d0"].alias("d0"), x["d"].alias("d"), hp.alias("hp"), hn.alias("hn"))

        def last(y: Column) -> Column:
            down = F.shiftright(y["d0"], 1)
            row = F.call_function("shiftleft", F.lit(1), F.greatest(m + k - 1 - j, F.lit(0)))  # the last row's bit once the band has met it
            bit = lambda word: F.when(word.bitwiseAND(row) != 0, 1).otherwise(0)
            d = F.when(j < m - k, y["d"] + F.when(y["d0"].bitwiseAND(F.lit(1 << top)) != 0, 0).otherwise(1)).otherwise(y["d"] + bit(y["hp"]) - bit(y["hn"]))
            return F.struct(y["hn"].bitwiseOR(F.lit(every).bitwiseXOR(down.bitwiseOR(y["hp"]))).alias("vp"), down.bitwiseAND(y["hp"]).alias("vn"), d.alias("d"))

        return _once(y, last)

    return F.aggregate(chars, first, step, lambda s: s["d"])


def _once(value: Column, use) -> Column:
    """use(value) with the value worked out once: expressions in lambdas have no common parts."""
    return F.element_at(F.transform(F.array(value), use), 1)


def is_near(a: Column, b: Column, edits: int) -> Column:
    """Whether two lines, of 2 * edits + 2 characters or more, are within `edits` edits."""
    sizes = F.struct(F.char_length(a).alias("a"), F.char_length(b).alias("b"), F.least(F.char_length(a), F.char_length(b)).alias("least"))
    pieces = [F.substring(a, F.floor(F.char_length(a) * i / PIECES).cast("int") + 1, F.floor(F.char_length(a) * (i + 1) / PIECES).cast("int") - F.floor(F.char_length(a) * i / PIECES).cast("int")) for i in range(PIECES)]
    # An edit spoils one piece at most.
    plausible = sum((F.when(F.contains(b, x), 1).otherwise(0) for x in pieces), F.lit(0)) >= PIECES - edits

    def core(s: Column) -> Column:
        rest = 2 * edits  # what stays of the shorter line at least
        steps = [F.floor((s["least"] - rest) * i / PIECES).cast("int") for i in range(PIECES + 1)]
        front = F.greatest(*[F.when(F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n), n).otherwise(0) for n in steps])
        back = F.greatest(*[F.when((n > 0) & (F.substring(a, s["a"] - n + 1, n) == F.substring(b, s["b"] - n + 1, n)), n).otherwise(0) for n in steps])
        return _once(F.struct(s["a"].alias("a"), s["b"].alias("b"), s["least"].alias("least"), front.alias("front"), back.alias("back")), cut)

    def cut(s: Column) -> Column:
        back = F.least(s["back"], s["least"] - 2 * edits - s["front"])
        own = lambda line, size: F.substring(line, s["front"] + 1, size - s["front"] - back)
        return banded_distance(own(a, s["a"]), own(b, s["b"]), edits) <= edits

    return (F.abs(F.char_length(a) - F.char_length(b)) <= edits) & plausible & _once(sizes, core)


def letter_counts(line: Column) -> Column:
    """How often each letter, of either case, stands in the line."""
    return F.struct(*((F.char_length(line) - F.char_length(F.translate(line, x + x.upper(), ""))).alias(x) for x in LETTERS))


def like_letters(a: Column, b: Column, edits: int) -> Column:
    """Not false for lines within `edits` edits: an edit takes one letter away, adds one, or both."""
    return sum((F.abs(a[x] - b[x]) for x in LETTERS), F.lit(0)) <= 2 * edits


def line_id() -> tuple[Column, Column]:
    """128 bits that name a line."""
    return F.xxhash64("line").alias("id"), F.xxhash64(F.lit("line"), "line").alias("id2")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast hashes if they are few; a staged table is counted from its footers."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def meetings(lines: DataFrame, edits: int) -> DataFrame:
    """(at, probe, lid): the lines of each key at which different lines meet, on its either side."""
    entries = keyed_lines(lines, edits)
    ends = entries.groupBy("at").agg(F.min("lid").alias("low"), F.max("lid").alias("high"))
    shared = staged(ends.where("low < high").select("at"), "line-keys")
    return staged(entries.join(_small(shared), "at").distinct(), "line-meetings")


def late_lines(lines: DataFrame, edits: int) -> DataFrame:
    """(id, id2) of the lines to which another line within `edits` stands earlier."""
    met = meetings(lines, edits)
    named = staged(met.select("lid").distinct(), "line-names")
    found = lines.withColumn("lid", F.xxhash64("line")).join(_small(named), "lid", "left_semi")
    texts = staged(found.groupBy("lid", "line").agg(F.min(F.struct("key", "line_no", "tid")).alias("first")).withColumn("letters", letter_counts(F.col("line"))), "line-texts")
    members = staged(met.join(texts, "lid"), "line-members")
    heads = members.groupBy("at", "probe").agg(F.min(F.struct("first", "line", "letters")).alias("head"), F.count(F.lit(1)).alias("n"))
    heads = heads.select("at", (~F.col("probe")).alias("probe"), F.col("head.first").alias("head_first"), F.col("head.line").alias("head_line"), F.col("head.letters").alias("head_letters"), "n")
    facing = staged(members.join(heads, ["at", "probe"]).where(F.col("head_first") < F.col("first")), "line-facing")
    pairs = facing.where(like_letters(F.col("head_letters"), F.col("letters"), edits)).select("line", "head_line").distinct()
    settled = staged(pairs.where(is_near(F.col("head_line"), F.col("line"), edits)).select(*line_id()).distinct(), "line-settled")
    rest = facing.where("n > 1").select("*", *line_id()).join(settled, ["id", "id2"], "left_anti").select("at", "probe", "first", "line", "letters")
    early = members.select(F.col("at").alias("at_a"), (~F.col("probe")).alias("probe_a"), F.col("first").alias("first_a"), F.col("line").alias("line_a"), F.col("letters").alias("letters_a"))
    same = (F.col("at") == F.col("at_a")) & (F.col("probe") == F.col("probe_a"))
    plausible = (F.col("first_a") < F.col("first")) & like_letters(F.col("letters_a"), F.col("letters"), edits)
    later = rest.join(early, same & plausible & is_near(F.col("line_a"), F.col("line"), edits), "left_semi")
    return settled.union(later.select(*line_id())).distinct()


def removed_lines(docs: DataFrame, edits: int = EDITS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """(key, tid, removed, n_exact, n_near): line numbers from 0 that go, of texts that lose any."""
    if near_chars < 2 * edits + 2:
        raise ValueError("lines this short are within the threshold of nearly anything")
    lines = occurrences(keyed_texts(docs))
    late = late_lines(lines.where(F.char_length("line") >= near_chars), edits).withColumn("near", F.lit(True))
    placed = lines.select(*line_id(), "key", "line_no", "tid")
    # The least key is all that every line needs; places within a key matter to repeated lines alone.
    ids = ["id", "id2"]
    classes = placed.groupBy(*ids).agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")).join(late, ids, "left")
    classes = staged(classes.where("n > 1 or near").select(*ids, "least", F.coalesce("near", F.lit(False)).alias("near")), "line-classes")
    again = staged(placed.join(_small(classes), ids), "line-repeats")
    heads = staged(again.where("key = least and not near").groupBy(*ids).agg(F.min(F.struct("line_no", "tid")).alias("head")), "line-heads")
    held = F.col("head").isNotNull() & (F.struct("line_no", "tid") == F.col("head")) & (F.col("key") == F.col("least"))
    gone = again.join(_small(heads), ids, "left").where(F.col("near") | ~held)
    marks = gone.groupBy("key", "tid").agg(F.collect_set(F.struct("line_no", "near")).alias("marks"))
    return marks.select(
        "key",
        "tid",
        F.array_sort(F.transform("marks", lambda x: x["line_no"])).alias("removed"),
        F.size(F.filter("marks", lambda x: ~x["near"])).cast("long").alias("n_exact"),
        F.size(F.filter("marks", lambda x: x["near"])).cast("long").alias("n_near"),
    )


def line_report(docs: DataFrame, edits: int = EDITS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """Per document its number of lines, how many go as equal or near ones, and their numbers from 0."""
    found = removed_lines(docs, edits, near_chars)
    texts = keyed_texts(docs).select("key", F.xxhash64("text").alias("tid"), F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"))
    all_ = texts.join(found, ["key", "tid"], "left")
    none = F.lit(0).cast("long")
    return all_.select(
        doc_id_of(F.col("key")).alias("doc_id"),
        "n_lines",
        F.coalesce("n_exact", none).alias("n_exact"),
        F.coalesce("n_near", none).alias("n_near"),
        F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed_lines"),
    )


def drop_lines(docs: DataFrame, edits: int = EDITS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """The documents, all columns, without the lines that go; n_chars follows the text."""
    found = removed_lines(docs, edits, near_chars).select(F.col("key").alias("__key"), F.col("tid").alias("__tid"), F.col("removed").alias("__removed"))
    key, tid = F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_KEY)), F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    joined = docs.join(found, (key == F.col("__key")) & (tid == F.col("__tid")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("__removed", i)), "\n")
    text = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(kept)
    columns = {"text": text} | ({"n_chars": F.char_length(text).cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {})
    return joined.withColumns(columns).select(*docs.columns)
