"""Operator 7: fuzzy line deduplication by MinHash, in DataFrame operations only.

Lines are compared in lower case without blanks at their ends. Equal lines are one class
by a 96-bit hash. A line's set has the distinct character shingles of length `gram` that
begin where a word begins (shorter at the line's end), and all that lie inside a word, as
64-bit hashes: so each character is in a shingle, and a line without blanks (a URL, code,
Chinese) has its shingles at every position. Its bands are MinHash values of that set: the
BANDED least hashes of the longer shingles, of `long_gram` characters, that begin at the
same places (of lines of LONG characters and more, at some of them: least_sampled), and for
a line under SHORT characters, which has few of them or none, the pairs of the BANDED
least hashes of the set. Two or three lines of a band are confirmed at once, in all pairs,
by the exact Jaccard similarity of the sets. Of more, those that have enough of the KEPT
least hashes of their sets in common are confirmed so, each against a few lines of the band
first; what is still open then is compared in blocks, and gives links only, never pairs. Components come from union-find; of each the first line (by doc_id,
text, place) stays.

All overlapping shingles as a set were tried and are out of reach here: README, check
figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, joined_ids, stored
from .linking import linked

BANDED = 4
SAMPLED = 6
SHORT = 80
KEPT = 16
#: Lines of this length have bands of sampled places; from it on to that over the
#: similarity they have both, so that two lines of a pair have one kind in common.
LONG = 160
FEW = 8
#: Anything but a consonant of ASCII or a blank. One by one, as Java looks such a class up in
#: one table, and asks a chain of tests for one of ranges.
_START = "[^bcdfghjklmnpqrstvwxyz ]"


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, th (a hash of the text), pos, norm of each line of at least min_chars
    characters in lower case and without white space at its ends. norm is made inside the
    array of lines, so it is made once however often it is used."""
    normal = F.transform(F.split("text", "\n"), lambda line: F.btrim(F.lower(line), F.lit(" \t\r")))
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.posexplode(normal).alias("pos", "norm"))
    return lines.filter(F.length("norm") >= min_chars)


def hashes(norm: Column, pattern: str) -> Column:
    """Ascending hashes of the distinct texts that the pattern's group finds."""
    return F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all(norm, F.lit(pattern), F.lit(1)), lambda g: F.xxhash64(g))))


def shingle_pattern(gram: int, least: int) -> str:
    """Finds the shingles of least to gram characters that begin a word and those of gram
    that lie inside one. It steps over the rest of a word that has no more of them, and over
    the blanks after it, so that not each place of a line is tried."""
    return rf"(?=((?<!\S)\S.{{{least - 1},{gram - 1}}}|\S{{{gram}}}))(?:\S{{0,{gram - 1}}}+(?!\S)\s*+|\S)"


def shingles(norm: Column, gram: int) -> Column:
    """Ascending hashes of the line's distinct shingles."""
    return hashes(norm, shingle_pattern(gram, 1))


def least_long(norm: Column, long_gram: int) -> Column:
    """The BANDED least hashes of the line's long shingles."""
    return F.slice(hashes(norm, shingle_pattern(long_gram, long_gram)), 1, BANDED)


def least_sampled(norm: Column, long_gram: int) -> Column:
    """The SAMPLED least hashes of the long shingles that begin, after a blank, with
    anything but a consonant of ASCII: the text chooses them, so a long line's copies have
    the same. Of a line that has few of them, or a word as long as such a shingle, those of
    all its long shingles, too."""

    def bands(x: Column) -> Column:
        wide = F.exists(F.split(norm, " "), lambda w: F.length(w) > long_gram)
        return F.when((F.size(x) < FEW) | wide, F.concat(F.slice(x, 1, SAMPLED), least_long(norm, long_gram))).otherwise(F.slice(x, 1, SAMPLED))

    # in an array of one, so that it is made once
    return F.transform(F.array(hashes(norm, rf" (?=({_START}.{{{long_gram - 1}}}))")), bands)[0]


def least_pairs(norm: Column, gram: int) -> Column:
    """Hashes of the pairs of the BANDED least hashes of the line's set; of a set of one, that."""

    def pairs(x: Column) -> Column:
        each = F.flatten(F.transform(x, lambda a, i: F.transform(F.slice(x, i + 2, BANDED), lambda b: F.xxhash64(a, b))))
        return F.when(F.size(x) < 2, x).otherwise(each)

    # in an array of one, so that the set is made once
    return F.transform(F.array(F.slice(shingles(norm, gram), 1, BANDED)), pairs)[0]


def banded(norm: Column, gram: int, long_gram: int, similarity: float) -> Column:
    n, long, sampled = F.length(norm), least_long(norm, long_gram), least_sampled(norm, long_gram)
    found = F.when(n < long_gram, least_pairs(norm, gram)).when(n < SHORT, F.concat(long, least_pairs(norm, gram)))
    return found.when(n < LONG, long).when(n < LONG / similarity, F.concat(long, sampled)).otherwise(sampled)


def similar(x: Column, y: Column, similarity: float) -> Column:
    both = F.size(F.array_intersect(x, y))
    return both >= F.lit(similarity) * (F.size(x) + F.size(y) - both)


def shared_bands(signed: DataFrame) -> DataFrame:
    """key, v: the bands that at least two different lines of signed (v, bands) have, and
    these lines. Bands are dealt once, for finding the shared ones and for joining them."""
    dealt = signed.select("v", F.explode("bands").alias("key")).repartition("key")
    keys = dealt.groupBy("key").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).filter("lo <> hi").select("key")
    return stored(dealt.join(keys.hint("shuffle_hash"), "key").distinct().select("key", "v"), "bands")


def few_and_many(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of shared (key, v) as pairs (a, b), a < b, each once, where a key has two
    or three lines, and as they are where it has more. Of three, the middle one is what
    the two others leave of the exclusive or of all."""
    groups = shared.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.bit_xor("v").alias("x"))
    mid = F.col("x").bitwiseXOR(F.col("lo")).bitwiseXOR(F.col("hi"))
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    lo, hi = F.col("lo"), F.col("hi")
    each = F.when(F.col("n") == 2, F.array(pair(lo, hi))).otherwise(F.array(pair(lo, hi), pair(lo, mid), pair(mid, hi)))
    pairs = groups.filter("n <= 3").select(F.explode(each).alias("p")).select("p.a", "p.b").distinct()
    return pairs, shared.join(groups.filter("n > 3").select("key"), "key")


def open_links(open_: DataFrame, sets: DataFrame, similarity: float, block: int = 200_000) -> DataFrame:
    """Links (a, b) between the components comp of rows (key, v, comp) that share a key,
    enough to connect all that are linked.

    Shingles that no other open line has can't be shared: a line that has too few others
    is out. The rest of a key is dealt in blocks of about `block` shingles; two blocks at
    a time meet in one row, where lines of different components are compared in the least
    key that both have. Such a row gives pairs of components, each once."""
    lines = stored(sets.join(open_.select("v").distinct(), "v"), "open_sets")
    alone = lines.select("v", F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.min("v").alias("v")).filter("n = 1")
    alone = alone.groupBy("v").agg(F.count("*").alias("own"))
    about = lines.join(alone, "v", "left").select("v", (F.size("s") - F.coalesce("own", F.lit(0))).alias("shared"), F.size("s").alias("n"))
    about = stored(about.filter(F.col("shared") >= F.lit(similarity) * F.col("n")), "open_sizes")
    left = open_.select("key", "v", "comp").join(about, "v")
    keys = left.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    left = stored(left.join(keys.filter("lo <> hi").select("key", "blocks"), "key"), "open_left")
    own = left.withColumn("b", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    units = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "v", "comp", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    keyed = left.groupBy("v").agg(F.collect_set("key").alias("ks"))  # at most one for each band of a line
    facts = lines.join(about.select("v", "shared"), "v").join(keyed, "v")
    rows = units.join(facts, "v").select("key", "i", "j", F.struct("b", "comp", "shared", "ks", "s").alias("row"))
    met = rows.groupBy("key", "i", "j").agg(F.collect_list("row").alias("rows"))

    def compared(x: Column) -> Column:
        def fits(y: Column) -> Column:
            sizes = F.size(x["s"]) + F.size(y["s"])
            bound = F.least(x["shared"], y["shared"]) * F.lit(1 + similarity) >= F.lit(similarity) * sizes
            first = F.array_min(F.array_intersect(x["ks"], y["ks"])) == F.col("key")
            return (y["b"] == F.col("j")) & (x["comp"] != y["comp"]) & ((F.col("i") != F.col("j")) | (x["comp"] < y["comp"])) & bound & first & similar(x["s"], y["s"], similarity)

        return F.array_distinct(F.transform(F.filter("rows", fits), lambda y: F.struct(F.least(x["comp"], y["comp"]).alias("a"), F.greatest(x["comp"], y["comp"]).alias("b"))))

    found = F.array_distinct(F.flatten(F.transform(F.filter("rows", lambda x: x["b"] == F.col("i")), compared)))
    return met.select(F.explode(found).alias("link")).select("link.a", "link.b").distinct()


def likely(shared: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The rows of shared (key, v) that can pass near(): of a line's sketch (v, x) enough
    hashes are in other lines' of the key. Lines that have a passage in common, but little
    else, end here, at the cost of their number."""
    rows = shared.join(sketches, "v").select("key", "v", "x.n", F.explode("x.s").alias("h"))
    others = F.count("*").over(Window.partitionBy("key", "h")) > 1
    found = rows.repartition("key").select("key", "v", "n", others.alias("met")).groupBy("key", "v", "n").agg(F.count_if("met").alias("met"))
    return found.filter(F.col("met") >= F.lit(0.5 * similarity) * F.least(F.lit(KEPT), F.ceil(F.lit(similarity) * F.col("n")))).select("key", "v")


def line_components(signed: DataFrame, similarity: float = 0.7, gram: int = 12, hubs: int = 3) -> DataFrame:
    """v, comp: the distinct lines of signed (v, norm, bands) that are linked to others."""
    shared = shared_bands(signed)
    wanted = joined_ids(signed.select("v", "norm"), shared.select("v").distinct(), "left_semi", "v").dropDuplicates(["v"])
    sets = stored(wanted.select("v", shingles(F.col("norm"), gram).alias("s")), "line_sets")
    sketches = sets.select("v", F.struct(F.slice("s", 1, KEPT).alias("s"), F.size("s").alias("n")).alias("x"))
    pairs, many = few_and_many(shared)
    kept = stored(likely(many, sketches, similarity), "likely")
    postings = stored(kept.join(sketches, "v").select("key", "v", "x"), "postings")

    def near(x: Column, y: Column) -> Column:
        """Sizes that leave the similarity possible, and signatures that make it likely:
        of lines as similar as asked, less than half the agreement falls short of it in
        one of some ten thousand pairs."""
        sizes = F.least(x["n"], y["n"]) >= F.lit(similarity) * F.greatest(x["n"], y["n"])
        agree = F.size(F.array_intersect(x["s"], y["s"]))
        return sizes & (agree >= F.lit(0.5 * similarity) * F.least(F.size(x["s"]), F.size(y["s"])))

    def confirm(pairs: DataFrame) -> DataFrame:
        sides = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
        return sides.filter(similar(F.col("sa"), F.col("sb"), similarity)).select("a", "b")

    known = stored(confirm(stored(pairs, "few")), "few_links")
    return linked(postings, confirm, lambda rows: open_links(rows, sets, similarity), near, 1, hubs, known)


def dropped(docs: DataFrame, min_chars: int = 20, similarity: float = 0.7, gram: int = 12, long_gram: int = 24) -> DataFrame:
    """doc_id, th, drop: the places (from 0) of each text's lines that go; texts without
    such lines have no row."""
    lines = line_rows(docs, min_chars).select("*", F.xxhash64("norm").alias("h1"), F.hash("norm").alias("h2"), banded(F.col("norm"), gram, long_gram, similarity).alias("bands"))
    lines = stored(lines, "lines")
    labels = line_components(lines.select(F.col("h1").alias("v"), "norm", "bands"), similarity, gram)
    # the first line of a group: by doc_id over classes, then by text and place among that
    # document's few. A null doc_id comes first
    places = lines.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.col("doc_id").alias("id"), "th", "pos", "h1", "h2")
    classes = places.groupBy("h1", "h2").agg(F.min("d").alias("d"), F.count("*").alias("n"))
    classes = classes.join(labels.withColumnRenamed("v", "h1"), "h1", "left").filter("n > 1 OR comp IS NOT NULL")
    group = F.when(F.col("comp").isNull(), F.struct("h1", "h2")).otherwise(F.struct(F.col("comp").alias("h1"), F.lit(None).cast("int").alias("h2")))
    classes = stored(classes.select("h1", "h2", "d", group.alias("group")), "line_classes")
    firsts = classes.groupBy("group").agg(F.min("d").alias("first"))
    grouped = stored(classes.join(firsts, "group").select("h1", "h2", "group", "first"), "line_groups")
    found = stored(places.join(grouped, ["h1", "h2"]).select("d", "id", "th", "pos", "group", "first"), "grouped_lines")
    keep = found.filter("d = first").groupBy("group").agg(F.min(F.struct("th", "pos")).alias("keep"))
    in_first = found.filter("d = first").join(keep, "group").filter(F.col("keep") != F.struct("th", "pos")).select("id", "th", "pos")
    gone = found.filter("d <> first").select("id", "th", "pos").unionByName(in_first)
    return gone.groupBy("id", "th").agg(F.array_distinct(F.collect_list("pos")).alias("drop")).withColumnRenamed("id", "doc_id")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text, any others) with the dropped lines cut out of text, and two more
    columns, n_lines and n_dropped (where docs has such names, with _ appended until free).

    The other lines stay as they are, in order. Null text stays null with 0 lines; empty
    lines and lines under min_chars characters always stay; a null doc_id comes before all
    others. Rows with the same doc_id and text are one document: they keep the same lines.
    No documents give no rows. Other columns of docs may have any names."""
    gone = stored(dropped(docs.select("doc_id", "text"), **options).toDF("id", "th", "drop"), "dropped")
    n, places = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("drop")), F.lit(0))).first()
    if n <= 500_000 and places <= 4_000_000:  # some tens of MB at most: the texts stay where they are
        gone = F.broadcast(gone)
    # the rows of docs travel in a struct, so that their names meet no others
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("h"))
    found = rows.join(gone, F.col("d").eqNullSafe(F.col("id")) & (F.col("h") == F.col("th")), "left")
    text = F.col("row")["text"]
    lines = F.split(text, "\n")
    kept = F.when(F.col("drop").isNull(), text).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("drop", i)), "\n"))
    own = [kept.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    n_lines, n_dropped = free_names(docs, "n_lines", "n_dropped")
    return found.select(*own, F.coalesce(F.size(lines), F.lit(0)).alias(n_lines), F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).alias(n_dropped))
