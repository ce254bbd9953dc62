"""Document fingerprints: a Merkle tree over sections, paragraphs and blocks, in DataFrame operations only.

Sections end at an empty line, paragraphs at a line feed, blocks after a word whose hash says so: their borders follow the
text, so an edit changes the blocks that it touches and no others. A block's node is the SHA-256 of its text, every other
node that of the nodes below it, each level with its own prefix. A fingerprint has the root in full and below it the tree
with shorter nodes. Roots test equality; where they differ, :func:`likeness` and :func:`changed_paragraphs` open only the
sections, and in them only the paragraphs, that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import task_count

#: A word with the white space after it, or white space that begins a paragraph.
_TOKEN = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+"
#: First digits of the MD5 of words that end a block: one word in eight.
_ENDS = ("0", "8")
_CUT, _ESCAPE = "\x1e", "\x1d"
_NODE = 8  # hexadecimal digits of a node below the root in a fingerprint
_QUANTILES, _ROWS_PER_RANGE = 128, 1024


def _hash(level: str, of: Column) -> Column:
    return F.sha2(F.concat(F.lit(level), of), 256)


def _blocks(paragraph: Column) -> Column:
    """A paragraph's blocks, which joined are the paragraph."""
    ends = lambda t: F.substring(F.md5(F.rtrim(t)), 1, 1).isin(*_ENDS)
    marked = F.transform(F.regexp_extract_all(paragraph, F.lit(_TOKEN), 0), lambda t: F.when(ends(t), F.concat(t, F.lit(_CUT))).otherwise(t))
    return F.split(F.regexp_replace(F.concat_ws("", marked), f"{_CUT}$", ""), _CUT)


def merkle_tree(text: Column) -> Column:
    """struct(root, sections array of struct(node, paragraphs array of struct(node, leaves array of string))) of a text.

    Null counts as empty. The character that marks borders is escaped where a text has it.
    """
    text = F.coalesce(text, F.lit(""))
    escaped = F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "0")), F.lit(_CUT), F.lit(_ESCAPE + "1"))
    text = F.when(F.contains(text, F.lit(_CUT)) | F.contains(text, F.lit(_ESCAPE)), escaped).otherwise(text)
    paragraph = lambda ls: F.struct(_hash("p", F.concat_ws("", ls)).alias("node"), ls.alias("leaves"))
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    section = lambda ps: F.struct(_hash("s", F.concat_ws("", ps["node"])).alias("node"), ps.alias("paragraphs"))
    sections = F.transform(
        F.split(text, "\n\n"),
        lambda s: once(F.transform(F.split(s, "\n"), lambda p: once(F.transform(_blocks(p), lambda b: _hash("b", b)), paragraph)), section),
    )
    return once(sections, lambda ss: F.struct(_hash("r", F.concat_ws("", ss["node"])).alias("root"), ss.alias("sections")))


def encode_tree(tree: Column) -> Column:
    """A tree as text: root:section/section, a section as node=paragraph;paragraph, a paragraph as its node and leaves, joined
    by commas. An empty paragraph has no leaf."""
    short = lambda node: F.substring(node, 1, _NODE)
    empty = F.sha2(F.lit("b"), 256)
    leaves = lambda p: F.transform(F.filter(p["leaves"], lambda x: x != empty), short)
    paragraph = lambda p: F.concat_ws(",", F.array(short(p["node"])), leaves(p))
    section = lambda s: F.concat(short(s["node"]), F.lit("="), F.concat_ws(";", F.transform(s["paragraphs"], paragraph)))
    return F.concat(tree["root"], F.lit(":"), F.concat_ws("/", F.transform(tree["sections"], section)))


def fingerprint_of(text: Column) -> Column:
    """The fingerprint of a text: equal for equal texts, and all that :func:`likeness` needs."""
    return F.element_at(F.transform(F.array(merkle_tree(text)), encode_tree), 1)


def _sections(fingerprint: Column) -> Column:
    return F.split(F.substring_index(fingerprint, ":", -1), "/")


def _leaves(paragraphs: Column) -> Column:
    """Distinct leaves of paragraphs, without the paragraphs' own nodes."""
    return F.array_distinct(F.flatten(F.transform(paragraphs, lambda p: F.slice(F.split(p, ","), F.lit(2), F.greatest(F.size(F.split(p, ",")) - 1, F.lit(0))))))


def leaf_count(fingerprint: Column) -> Column:
    """How many distinct leaves a fingerprint has."""
    return F.size(_leaves(F.flatten(F.transform(_sections(fingerprint), lambda s: F.split(F.substr(s, F.lit(_NODE + 2)), ";")))))


def likeness(a: Column, b: Column, leaves_a: Column | None = None, leaves_b: Column | None = None) -> Column:
    """1 for equal roots, else how much of two fingerprints' leaves do not differ; below 1, and 0 where nothing is alike.

    Only sections that the other one lacks are opened, in those only paragraphs, in those the leaves.
    """
    n = (leaf_count(a) if leaves_a is None else leaves_a) + (leaf_count(b) if leaves_b is None else leaves_b)
    paragraphs = lambda x, y: F.flatten(F.transform(F.array_except(_sections(x), _sections(y)), lambda s: F.split(F.substr(s, F.lit(_NODE + 2)), ";")))

    def within(d: Column) -> Column:
        left, right = _leaves(F.array_except(d["a"], d["b"])), _leaves(F.array_except(d["b"], d["a"]))
        return F.element_at(F.transform(F.array(F.struct(left.alias("a"), right.alias("b"))), lambda s: F.size(F.array_except(s["a"], s["b"])) + F.size(F.array_except(s["b"], s["a"]))), 1)

    apart = F.element_at(F.transform(F.array(F.struct(paragraphs(a, b).alias("a"), paragraphs(b, a).alias("b"))), within), 1)
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.lit(1.0)).when(n == 0, F.lit(0.0)).otherwise(F.least(1.0 - apart / n, 1.0 - 1.0 / (n + 1)))


def changed_paragraphs(tree_a: Column, tree_b: Column) -> Column:
    """Array of struct(section, paragraph), from 0, at which two trees differ; equal roots and sections aren't opened.

    A section or paragraph that only one tree has counts as differing.
    """
    none = F.array().cast("array<struct<section:int,paragraph:int>>")

    def within(a: Column, b: Column, s: Column) -> Column:
        n = F.greatest(F.coalesce(F.size(a["paragraphs"]), F.lit(0)), F.coalesce(F.size(b["paragraphs"]), F.lit(0)))
        at = F.filter(F.sequence(F.lit(0), n - 1), lambda k: ~F.get(a["paragraphs"]["node"], k).eqNullSafe(F.get(b["paragraphs"]["node"], k)))
        return F.transform(at, lambda k: F.struct(s.cast("int").alias("section"), k.cast("int").alias("paragraph")))

    pairs = F.arrays_zip(tree_a["sections"].alias("a"), tree_b["sections"].alias("b"))
    found = F.flatten(F.transform(pairs, lambda p, s: F.when(p["a"]["node"].eqNullSafe(p["b"]["node"]), none).otherwise(within(p["a"], p["b"], s))))
    return F.when(tree_a["root"] == tree_b["root"], none).otherwise(found)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every row of ``docs`` (doc_id, text; other columns are ignored). Null text: as empty."""
    return docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), fingerprint_of(F.col("text")).alias("fingerprint"))


def _ranges(docs: DataFrame) -> tuple[Column, int]:
    """A column that deals rows (doc_id, _tie) to ranges of about 1,024 in ascending order, and the bytes of all texts.

    Ranges lie between 128 quantiles of doc_id, as many in each as rows ask for. Rows without an id, and those of an id that
    fills a quantile, are dealt by _tie, a number that spreads evenly.
    """
    q = F.percentile_approx("doc_id", [i / _QUANTILES for i in range(_QUANTILES + 1)], 10_000)
    stats = docs.agg(F.count("doc_id").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), q.alias("q"), F.sum(F.octet_length("text")).alias("bytes")).first()
    every = list(stats["q"] or [0])
    cuts = sorted(set(every))
    per = max(1, -(-stats["n"] // (_QUANTILES * _ROWS_PER_RANGE)))
    often = [max(every.count(c) - 1, 0) for c in cuts]
    step = max(per * max([1, *often]), -(-stats["nulls"] // _ROWS_PER_RANGE), 1)
    at = F.greatest(F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("doc_id"))), F.lit(1))
    low, high = (F.element_at(F.lit(x), at).cast("double") for x in (cuts, [*cuts[1:], cuts[-1] + 1]))
    hot = F.element_at(F.lit(often), at)
    spread = (F.col("_tie").cast("double") / 2.0**64 + 0.5)  # 0 to 1, in order of _tie
    part = lambda share, n: F.least(F.greatest(F.floor(share * n), F.lit(0)), n - 1).cast("long")
    by_id = (2 * at.cast("long") + 1) * step + part((F.col("doc_id") - low) / (high - low), F.lit(per))
    by_tie = 2 * at.cast("long") * step + part(spread, hot * per)
    place = F.when(F.col("doc_id").isNull(), part(spread, F.lit(max(1, -(-stats["nulls"] // _ROWS_PER_RANGE))))).when((hot > 0) & (F.col("doc_id") == low), by_tie).otherwise(by_id)
    return place, stats["bytes"] or 0


def with_next(docs: DataFrame) -> DataFrame:
    """Each row with its fingerprint and with the text and fingerprint of the next row by descending doc_id.

    The last row's next is the first. Rows lie in ranges in that order; a range also gets the head of the one below it, so
    texts move once and no sort is global. Rows of one doc_id are ordered by a hash of their text; null doc_id comes last.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_tie"))
    place, size = _ranges(rows)
    rows = rows.withColumn("_range", place)
    # the first row of each range in this order is the next one of the last row of the range above it
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "_tie", "text")
    heads = rows.groupBy("_range").agg(F.max(key).alias("_head"))
    # ranges above: within a thousand of them, and for the last of those the first of the next thousand that has any
    named = heads.select("_range", F.floor(F.col("_range") / 1024).alias("_group"))
    groups = named.groupBy("_group").agg(F.min("_range").alias("_least"), F.max("_range").alias("_most"))
    turn = Window.partitionBy("_super").orderBy("_group")
    groups = groups.withColumn("_super", F.floor(F.col("_group") / 1024))
    supers = groups.groupBy("_super").agg(F.min("_least").alias("_first"))
    above = Window.orderBy("_super")  # one row for a thousand million documents
    first = F.min("_first").over(above.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    supers = supers.select("_super", F.coalesce(F.lead("_first").over(above), first).alias("_after"))
    groups = groups.withColumn("_up", F.lead("_least").over(turn)).join(supers, "_super").select("_group", F.coalesce("_up", "_after").alias("_up"))
    goes = named.withColumn("_next", F.lead("_range").over(Window.partitionBy("_group").orderBy("_range"))).join(groups, "_group")
    goes = goes.select("_range", F.coalesce("_next", "_up").alias("_to"))
    guests = heads.join(goes, "_range").select("_head.doc_id", "_head.text", "_head._tie", F.col("_to").alias("_range"), F.lit(True).alias("_guest"))
    both = rows.withColumn("_guest", F.lit(False)).unionByName(guests).repartition(task_count(docs.sparkSession, size), "_range")
    both = both.withColumn("fingerprint", fingerprint_of(F.col("text")))
    in_order = Window.partitionBy("_range").orderBy("_guest", F.col("doc_id").desc_nulls_last(), F.col("_tie").desc(), F.col("text").desc())
    both = both.withColumns({f"next_{c}": F.lead(c).over(in_order) for c in ("text", "fingerprint")})
    return both.where(~F.col("_guest")).drop("_range", "_guest", "_tie")


def compare_with_edit(docs: DataFrame) -> DataFrame:
    """Fingerprint each text and an edited form of it, and how alike they and the next document are.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, one row per row of
    ``docs`` (doc_id, text; other columns are ignored). The edit replaces the last floor(n_chars / 2) code points by the
    first as many of the next text by descending doc_id. Null text: as empty. A single row is its own next. Empty table:
    no rows. Rows of one doc_id follow each other by a hash of their text; null doc_id comes last.
    """
    rows = with_next(docs).withColumn("n_chars", F.char_length("text"))
    half = F.expr("n_chars div 2").cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.withColumn("edited_fingerprint", fingerprint_of(F.col("edited"))).withColumn("_leaves", leaf_count(F.col("fingerprint")))
    return rows.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), F.col("_leaves")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), F.col("_leaves")).alias("near_next"),
    )
