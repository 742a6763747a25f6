"""Line dedup by an exact set-similarity join, with DataFrame functions only.

A line's tokens are its five-word shingles; a line of fewer words counts as one token, so that only an equal line
resembles it. Tokens are ordered by rarity, that of the word that begins them, which bounds their own: all words of
all texts are counted in hash buckets, and a token comes the earlier the lower the count of its first word's bucket, then by
hashes. The order is fixed before prefixes are cut, so any counts give the same result; good ones keep frequent tokens
out of the prefixes.

Of a line with n tokens at least the first n - ceil(t n) + DEPTH are its prefix. Two similar lines share at least
min(DEPTH, ceil(t n)) tokens of their prefixes (prefix filter). Where a prefix token meets another line's, pairs are
dropped whose lengths (length filter), whose places in the order (positional filter) or whose parities of hashed tokens
(at least as many tokens differ as bits do) rule the threshold out. The rest are verified by their Jaccard similarity on whole sets.
A line is removed if it equals an earlier line, or is similar to the first occurrence of another line that is
earlier, removed or not. Earlier: by document (those without id first), then by line.

Lines with equal words are one class, so copies are joined once. Tokens of many classes are crowded: their
classes are first compared with two of them, and those that this doesn't settle with all, block by
block; such pairs never become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, free_names, keep

GAPS = r"[ \t\n\x0B\f\r]+"
SHINGLE = 5
#: log2 of the number of counters behind the order of tokens, whatever the size of the input.
BUCKET_BITS = 14
#: Shared prefix tokens asked of a pair of long lines.
DEPTH = 3
#: Lines with at least so many copies, and how many of them at most, are known to all tasks (about 40 bytes each).
HOT_FROM, MOST_HOT = 1000, 10_000
#: Classes of a token from which on it is crowded, and classes of a block.
CROWDED_FROM, BLOCK = 64, 1024
#: Lines asked for, or removed, up to which their numbers are sent to all executors (about 60 bytes each) rather than texts shuffled.
BROADCAST_ROWS = 500_000

#: A token: leading bits of its first word's key, by which it is ordered, and 40 bits of the hash of all its words.
_LOW = 2**40 - 1
_TOKEN = f"({{first}} & ~{_LOW}L) | shiftrightunsigned(xxhash64({{first}}, get({{k}}, {{i}}+1), get({{k}}, {{i}}+2), get({{k}}, {{i}}+3), get({{k}}, {{i}}+4)), 24)"
#: For each of 256 values of the tokens' low bits, which are well mixed, whether an odd number of tokens has it: four longs.
#: Of unrelated lines about half of them differ; half of 64 values is no more than two lines of 150 tokens may differ in.
_PARITY = "named_struct({})".format(", ".join(f"'p{g}', aggregate(tokens, 0L, (a, t) -> if((t & 192) = {64 * g}, a ^ shiftleft(1L, cast(t & 63 as int)), a))" for g in range(4)))


def _words(line: Column, odd: Column) -> Column:
    """A line's words. Splitting at single blanks is much cheaper than by pattern; other gaps are rare."""
    return F.array_remove(F.when(odd, F.split(line, GAPS)).otherwise(F.split(line, " ")), "")


def _odd(text: Column) -> Column:
    return text.contains("\t") | text.contains("\r") | text.contains("\x0b") | text.contains("\x0c")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, dh, line_no, line, odd, cid) for each line; cid is one hash for all lines with the same words."""
    # what is selected beside explode() is computed for each of its rows: a text's columns come before
    texts = docs.select("doc_id", F.xxhash64("text").alias("dh"), _odd(F.col("text")).alias("odd"), "text")
    # the outer form: for the other one a filter on the array is inferred, which computes it a second time
    lines = texts.select("doc_id", "dh", "odd", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line")).where("line is not null")
    line = F.col("line")
    loose = F.col("odd") | line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    plain = F.when(loose, F.array_join(_words(line, F.col("odd")), " ")).otherwise(line)
    return lines.select("doc_id", "dh", "line_no", "line", "odd", F.xxhash64(plain).alias("cid"))


def _order(docs: DataFrame) -> Column:
    """For each bucket what turns a word hash's leading bits into the rank of its bucket, rarest first."""
    words = docs.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counts = words.select(F.shiftrightunsigned(F.xxhash64("w"), 64 - BUCKET_BITS).cast("int").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    known = {r["bucket"]: r["n"] for r in counts.collect()}  # 2^BUCKET_BITS rows at most
    turn = [0] * (1 << BUCKET_BITS)
    for rank, bucket in enumerate(sorted(range(1 << BUCKET_BITS), key=lambda b: (known.get(b, 0), b))):
        bits = bucket ^ rank ^ (1 << (BUCKET_BITS - 1))  # longs are signed: the rank's top bit is turned
        turn[bucket] = (bits - (bits >> (BUCKET_BITS - 1) << BUCKET_BITS)) << (64 - BUCKET_BITS)
    return F.split(F.lit(",".join(map(str, turn))), ",").cast("array<bigint>")


def _keys(lines: DataFrame, turn: Column, *columns: str) -> DataFrame:
    """columns, and the keys k of each line's words: hashes whose leading bits are the rank of their bucket."""
    words = lines.select(*columns, _words(F.col("line"), F.col("odd")).alias("w"))
    hashed = words.select(*columns, F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    key = lambda h: h.bitwiseXOR(turn[F.shiftrightunsigned(h, 64 - BUCKET_BITS)])
    return hashed.select(*columns, F.transform("h", key).alias("k"))


def _prefixes(lines: DataFrame, turn: Column, percent: int, depth: int) -> DataFrame:
    """(token, cid, need) of each line's prefix; need: shared ones that a similar line must have."""
    firsts = F.when(F.size("k") >= SHINGLE, F.sort_array(F.array_distinct(F.slice("k", F.lit(1), F.size("k") - (SHINGLE - 1)))))
    cut = _keys(lines, turn, "cid").select("cid", "k", F.size("k").alias("m"), firsts.alias("firsts"))
    # as many lowest first words as the prefix asks bring at least as many tokens
    most = F.col("m") - (SHINGLE - 1)
    want = F.least(F.size("firsts"), most - F.ceil(most * percent / 100).cast("int") + depth)
    cut = cut.select("cid", "k", "m", F.expr("firsts")[want - 1].alias("last"), F.least(F.lit(depth), F.ceil(F.size("firsts") * percent / 100)).cast("int").alias("need"))
    rows = cut.select("cid", "k", "m", "last", "need", F.posexplode_outer("k").alias("i", "own"))
    # coalesce: from a plain comparison a filter is inferred that computes the keys a second time
    rows = rows.where(f"coalesce(own <= (last | {_LOW}) and i <= m - {SHINGLE}, false)")
    return rows.select(F.coalesce(F.expr(_TOKEN.format(first="own", k="k", i="i")), F.lit(0).cast("long")).alias("token"), "cid", "need")


def _fetch(docs: DataFrame, wanted: DataFrame, turn: Column) -> DataFrame:
    """(cid, at, tokens) of wanted classes (cid, at): the distinct tokens in their order."""
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    asked = wanted.groupBy(F.col("at.doc_id").alias("id"), F.col("at.dh").alias("ah")).agg(F.collect_list(F.struct("at.line_no", "cid")).alias("asked"))
    side = F.broadcast(asked) if few else asked
    texts = docs.withColumn("dh", F.xxhash64("text"))
    found = texts.join(side, (texts["dh"] == side["ah"]) & texts["doc_id"].eqNullSafe(side["id"])).select("id", "ah", _odd(F.col("text")).alias("odd"), F.split("text", "\n").alias("lines"), "asked")
    each = F.transform("asked", lambda a: F.struct(F.element_at("lines", a["line_no"] + 1).alias("line"), a["cid"].alias("cid"), a["line_no"].alias("line_no")))
    lines = found.select("id", "ah", "odd", F.explode_outer(each).alias("a"))
    lines = lines.select("a.line", "a.cid", F.struct(F.col("id").alias("doc_id"), F.col("ah").alias("dh"), "a.line_no").alias("at"), "odd")
    shingles = f"transform(slice(k, 1, size(k) - {SHINGLE - 1}), (x, i) -> {_TOKEN.format(first='x', k='k', i='i')})"
    return _keys(lines, turn, "cid", "at").select("cid", "at", F.expr(f"sort_array(array_distinct({shingles}))").alias("tokens"))


def _near(x: str, y: str, percent: int) -> Column:
    """What every pair that reaches the threshold fulfils at the first token that it shares."""
    c = lambda s, name: F.col(f"{s}.{name}")
    total = c(x, "n") + c(y, "n")
    out = (F.least(c(x, "n"), c(y, "n")) * 100 >= F.greatest(c(x, "n"), c(y, "n")) * percent) & (F.least(c(x, "n") - c(x, "place"), c(y, "n") - c(y, "place")) * (100 + percent) >= total * percent)
    odd = [F.bit_count(c(x, f"parity.p{g}").bitwiseXOR(c(y, f"parity.p{g}"))) for g in range(4)]
    return out & ((odd[0] + odd[1] + odd[2] + odd[3]) * (100 + percent) <= total * (100 - percent))


def _alike(x: Column, y: Column, percent: int) -> Column:
    inter = F.size(F.array_intersect(x, y))
    return (F.size(x) + F.size(y) - inter) * percent <= inter * 100


def _similar(docs: DataFrame, first: DataFrame, hot: DataFrame, percent: int, depth: int, crowded_from: int, block: int) -> DataFrame:
    """cid of each class that is similar to an earlier one."""
    turn = _order(docs)
    lines = _lines(docs)
    own = F.struct("doc_id", "dh", "line_no")
    # of a line with very many copies only the first gives tokens
    lines = lines.join(F.broadcast(hot.select("cid", "at")), "cid", "left").where(F.col("at").isNull() | F.col("at").eqNullSafe(own)).select("cid", "line", "odd")
    rows = _prefixes(lines, turn, percent, depth).repartition(F.col("token"))
    # tokens of one class only can't be shared; both sides read one exchange, so both must need all its columns
    several = rows.groupBy("token").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.min("need").alias("least")).where("lo <> hi and least >= 0").select("token")
    shared = rows.join(several.hint("shuffle_hash"), "token").distinct()
    # a class needs enough shared tokens
    able = shared.groupBy("cid").agg(F.count("*").alias("shares"), F.max("need").alias("need")).where("shares >= need").select("cid")
    able = keep(able.join(first.select("cid", "at"), "cid"))
    sets = keep(_fetch(docs, able, turn).select("*", F.size("tokens").alias("n"), F.expr(_PARITY).alias("parity")))
    if sets.count() > able.count():  # rows that repeat a document give its lines again
        again, sets = sets, keep(sets.dropDuplicates(["cid"]))
        forget(again)
    cut = F.slice("tokens", F.lit(1), F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + depth)
    sizes = keep(sets.select(F.explode(cut).alias("token")).groupBy("token").agg(F.count("*").alias("classes")).where("classes > 1"))
    placed = sets.select("cid", "at", "n", "parity", F.posexplode(cut).alias("place", "token"))
    placed = keep(placed.join(sizes, "token"))
    crowded = keep(sizes.where(F.col("classes") >= crowded_from))

    def verified(pairs: DataFrame) -> DataFrame:
        """Classes with an earlier similar one among pairs (a later, b earlier)."""
        both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("cid").alias("b"), F.col("tokens").alias("tb")), "b")
        return both.where(_alike(F.col("ta"), F.col("tb"), percent)).select(F.col("a").alias("cid")).distinct()

    # of each crowded token's classes of about one length two stand for the others: the earliest one, and the one with the
    # token first in its order, which among near copies of a line is the one without changes
    many = keep(placed.where(F.col("classes") >= crowded_from).drop("classes").withColumn("wide", F.floor(F.log("n") * 8)))
    info = ["at", "cid", "n", "place", "parity"]
    heads = many.groupBy("token", "wide").agg(F.min(F.struct(*info)).alias("y"), F.min(F.struct("place", *[c for c in info if c != "place"])).alias("z"))
    led = many.select("token", "wide", F.struct(*info).alias("x")).join(heads, ["token", "wide"])
    pairs = None
    for head in ("y", "z"):
        one = led.where(F.col(f"{head}.at") < F.col("x.at")).where(_near("x", head, percent)).select(F.col("x.cid").alias("a"), F.col(f"{head}.cid").alias("b"))
        pairs = one if pairs is None else pairs.unionByName(one)
    gone = keep(verified(pairs.distinct()))

    # the other tokens: pairs that share enough of them
    few = placed.where(F.col("classes") < crowded_from).drop("classes")
    x, y = few.join(gone, "cid", "left_anti").alias("x"), few.alias("y")
    meet = x.join(y, "token").where((F.col("y.at") < F.col("x.at")) & _near("x", "y", percent)).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()
    more = keep(verified(meet).unionByName(gone).distinct())

    # classes of crowded tokens that are still open, block by block
    left = many.join(more, "cid", "left_anti")
    dealt = crowded.select("token", F.ceil(F.col("classes") / block).cast("int").alias("blocks"))
    mine = lambda: F.pmod(F.xxhash64("cid", "token"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tokens = sets.select("cid", "tokens")
    x = left.join(dealt, "token").withColumn("i", mine()).withColumn("j", every).join(tokens, "cid").alias("x")
    # only blocks of tokens that an open class has
    y = many.join(left.select("token").distinct().join(dealt, "token"), "token").withColumn("j", mine()).withColumn("i", every).join(tokens, "cid").alias("y")
    keys = (F.col("x.token") == F.col("y.token")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    on = keys & (F.col("y.at") < F.col("x.at")) & _near("x", "y", percent) & _alike(F.col("x.tokens"), F.col("y.tokens"), percent)
    last = x.join(y, on, "left_semi").select("cid")
    out = keep(more.unionByName(last).distinct())
    for used in (able, sets, sizes, placed, crowded, many, gone, more):
        forget(used)
    return out


def removed_lines(docs: DataFrame, percent: int = 80, depth: int = DEPTH, crowded_from: int = CROWDED_FROM, block: int = BLOCK) -> DataFrame:
    """(doc_id, dh, removed) for each distinct text with its doc_id that loses lines: their numbers from 0, in order.

    dh is the text's 64-bit hash. Lines are cut at line feeds; those without words stay, those of one to four words go
    if an equal line comes before. Null and empty texts lose nothing; an empty table gives no rows. Rows that repeat a doc_id
    with its text are read as one; another text under the same doc_id is a document of its own, and so are rows
    without id, which come first. Other columns are ignored. Word runs and lines are told apart by 64-bit hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = keep(_lines(docs).select("doc_id", "dh", "line_no", "cid"))
    wordy = lines.where(F.col("cid") != F.xxhash64(F.lit("")))
    own = F.struct("doc_id", "dh", "line_no")
    first = keep(wordy.groupBy("cid").agg(F.min(own).alias("at"), F.count("*").alias("copies")))
    hot = keep(first.where(F.col("copies") >= HOT_FROM).orderBy(F.desc("copies"), "cid").limit(MOST_HOT))
    similar = _similar(docs, first, hot, percent, depth, crowded_from, block)

    # only classes with copies or with an earlier similar one lose lines; very frequent ones are told by all tasks
    verdict = first.join(similar.withColumn("similar", F.lit(True)), "cid", "left").where("copies > 1 or similar").select("cid", "at", F.coalesce("similar", F.lit(False)).alias("similar"))
    often = hot.select("cid").join(verdict, "cid")
    drop = F.col("similar") | ~F.col("at").eqNullSafe(own)
    told = wordy.join(F.broadcast(often), "cid").where(drop).select("doc_id", "dh", "line_no")
    rest = wordy.join(F.broadcast(hot.select("cid")), "cid", "left_anti").join(verdict, "cid").where(drop).select("doc_id", "dh", "line_no")
    out = keep(told.unionByName(rest).groupBy("doc_id", "dh").agg(F.sort_array(F.collect_set("line_no")).alias("removed")))
    for used in (lines, first, hot, similar):
        forget(used)
    return out


def line_report(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) for each row of docs (doc_id, text; other columns are ignored).

    removed lists line numbers from 0, joined by commas. Null texts have no lines, an empty text has one; an empty
    table gives no rows.
    """
    found = removed_lines(docs, percent).select(F.col("doc_id").alias("id"), F.col("dh").alias("fh"), "removed")
    n = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("dh"), n.alias("n_lines"))
    out = rows.join(found, (F.col("dh") == F.col("fh")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return out.select(
        "doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed"),
    )


def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with the kept lines of each text; n_chars follows, where there is such a column. No row is dropped.

    Null and empty texts stay as they are; a text that loses all its lines is empty. An empty table stays empty.
    """
    key, digest, gone, every = free_names(docs, "_id", "_dh", "_removed", "_lines")
    found = removed_lines(docs, percent).select(F.col("doc_id").alias(key), F.col("dh").alias(digest), F.col("removed").alias(gone))
    # texts stay where they are if the numbers can come to them
    numbers = found.agg(F.sum(F.size(gone))).first()[0] or 0
    side = F.broadcast(found) if numbers <= BROADCAST_ROWS else found
    joined = docs.join(side, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(digest)), "left")
    # a column of its own: within the function below the text would be split again for each line
    joined = joined.withColumn(every, F.when(F.col(gone).isNotNull(), F.split("text", "\n")))
    kept = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), gone)
    out = joined.withColumn("text", F.when(F.col(gone).isNotNull(), F.array_join(F.transform(kept, lambda i: F.col(every)[i]), "\n")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
