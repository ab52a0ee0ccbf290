"""Document fingerprints: a Merkle tree over sections and paragraphs, in DataFrame functions only.

Leaves are runs of text within a paragraph (a sentence, cut after 160 characters), nodes are
paragraphs (lines) and sections (from a blank line or a heading to the next), and the root is
the SHA-256 over the sections. Equal roots mean equal texts; where roots differ, the branches
that differ locate the edit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table

#: Places after which a section starts: a blank line, or a line end before a heading.
SECTION_END = r"(?<=\n\n)|(?<=\n)(?=#{1,6} )"
PARAGRAPH_END = r"(?<=\n)"
#: Every character of a paragraph lies in exactly one match.
LEAF = r"[^.!?]{1,160}(?:[.!?]+\s?)?|[.!?]+\s?"


def tree(text: Column) -> Column:
    """array of sections, each an array of paragraphs, each an array of 64-bit leaf hashes. Null counts as empty."""

    def leaves(paragraph: Column) -> Column:
        return F.transform(F.regexp_extract_all(paragraph, F.lit(LEAF), F.lit(0)), lambda x: F.xxhash64(x))

    def paragraphs(section: Column) -> Column:
        return F.transform(F.split(section, PARAGRAPH_END), leaves)

    return F.transform(F.split(F.coalesce(text, F.lit("")), SECTION_END), paragraphs)


def _hash(children: Column) -> Column:
    return F.sha2(F.concat_ws(",", children).cast("binary"), 256)


def node_hashes(tree_col: Column) -> Column:
    """array<struct<hash, paragraphs array<string>>>: the inner nodes, sections over paragraphs."""

    def section(s: Column) -> Column:
        below = F.transform(s, lambda p: _hash(p.cast("array<string>")))
        return F.struct(_hash(below).alias("hash"), below.alias("paragraphs"))

    return F.transform(tree_col, section)


def root(tree_col: Column) -> Column:
    return _hash(F.transform(tree_col, lambda s: _hash(F.transform(s, lambda p: _hash(p.cast("array<string>"))))))


def leaves(tree_col: Column) -> Column:
    return F.array_distinct(F.flatten(F.flatten(tree_col)))


def fingerprint(root_col: Column, leaves_col: Column) -> Column:
    """Root, then the distinct leaves in order of appearance: what likeness compares."""
    return F.concat(root_col, F.lit(":"), F.concat_ws("", F.transform(leaves_col, lambda h: F.lpad(F.hex(h), 16, "0"))))


def leaves_of(fingerprint_col: Column) -> Column:
    """The leaves that a fingerprint string carries."""
    body = F.substring_index(fingerprint_col, ":", -1)
    return F.regexp_extract_all(body, F.lit("[0-9A-F]{16}"), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal leaf sets (both empty included), else shared leaves over all leaves."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, sections (inner nodes with their hashes), fingerprint.

    Null text counts as empty; a null id stays null; repeated rows give a row each; an empty table
    gives an empty one; very long texts are hashed whole; other columns are not read.
    """
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    t = t.select("doc_id", F.length("text").cast("long").alias("n_chars"), tree(F.col("text")).alias("tree"))
    return t.select("doc_id", "n_chars", node_hashes(F.col("tree")).alias("sections"), fingerprint(root(F.col("tree")), leaves(F.col("tree"))).alias("fingerprint"))


def locate_edits(old: Column, new: Column) -> Column:
    """Branches that differ between two ``sections`` columns: array<struct<section, paragraph>> (0-based, by place).

    Equal branches are skipped whole; a missing branch differs.
    """
    none = F.lit(None).cast("struct<hash:string,paragraphs:array<string>>")

    def pick(sections: Column, i: Column) -> Column:
        return F.when(i < F.size(sections), F.element_at(sections, (i + 1).cast("int"))).otherwise(none)

    def differing(i: Column) -> Column:
        a, b = pick(old, i), pick(new, i)
        n = F.greatest(F.coalesce(F.size(a["paragraphs"]), F.lit(0)), F.coalesce(F.size(b["paragraphs"]), F.lit(0)))
        every = F.filter(F.sequence(F.lit(0), n - 1), lambda j: ~F.get(a["paragraphs"], j).eqNullSafe(F.get(b["paragraphs"], j)))
        found = F.transform(every, lambda j: F.struct(i.cast("int").alias("section"), j.cast("int").alias("paragraph")))
        return F.when(a["hash"].eqNullSafe(b["hash"]), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(found)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(old), F.size(new)) - 1), differing))


def successors(ids: DataFrame) -> DataFrame:
    """doc_id, next_id: the neighbour of each distinct non-null id in descending order, the smallest followed by the largest.

    A range sort numbers the ids (partition starts come from one count a partition), and an
    equi-join on the number finds the neighbour: no single task sees all ids.
    """
    ranged = ids.where("doc_id IS NOT NULL").distinct().repartitionByRange(F.col("doc_id").desc()).sortWithinPartitions(F.col("doc_id").desc())
    placed = write_table(ranged.select("doc_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("mid")), "merkle-order")
    per_part = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = per_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    place = F.col("mid").bitwiseAND((1 << 33) - 1)
    ranked = placed.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + place).alias("rank"), "total")
    a, b = ranked.alias("a"), ranked.alias("b")
    pairs = a.join(b, F.expr("(a.rank + 1) % a.total = b.rank"))
    return pairs.select(F.col("a.doc_id").alias("doc_id"), F.col("b.doc_id").alias("next_id"))


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit, whose last third comes from the next document.

    The last floor(n_chars / 3) code points give way to the first as many (or all) of the next
    document's text, ids descending, the smallest followed by the largest. Columns: doc_id,
    n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next. Rows that repeat
    an id are each a document, and the smallest of their texts is what the neighbour takes. A row
    without id has no neighbour: its edit loses the last third and near_next is null. A single
    document is its own neighbour. Null texts count as empty, and two empty texts are alike (1).
    """
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    follow = successors(t.select("doc_id"))
    # what each document gives to the one before it: as many characters as that one's third
    wanted = t.groupBy("doc_id").agg(F.max(F.floor(F.length("text") / 3)).cast("int").alias("want"))
    asked = follow.join(wanted, "doc_id").select(F.col("next_id").alias("asked_id"), F.col("doc_id").alias("to_id"), "want")
    # both sides below read one exchange of the texts: no filter and no column may differ under it,
    # so rows that nobody asks keep a place of their own (nobody) instead of being filtered
    keyed = t.repartition(F.col("doc_id"))
    nobody = F.lit(-(1 << 63))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    gives = keyed.withColumn("nth", first).where("nth = 1").join(asked, F.col("doc_id") == F.col("asked_id"), "left")
    gives = gives.select(F.coalesce("to_id", nobody).alias("to_id"), F.expr("left(text, want)").alias("next_prefix"), leaves(tree(F.col("text"))).alias("next_leaves"))
    grown = keyed.withColumn("n_chars", F.length("text").cast("long")).withColumn("tree", tree(F.col("text"))).withColumn("leaves", leaves(F.col("tree")))
    both = grown.join(gives, F.col("doc_id") == F.col("to_id"), "left")
    edited = F.concat(F.expr("left(text, n_chars - floor(n_chars / 3))"), F.coalesce(F.expr("left(next_prefix, floor(n_chars / 3))"), F.lit("")))
    both = both.withColumn("edited_text", edited).withColumn("edited_tree", tree(F.col("edited_text"))).withColumn("edited_leaves", leaves(F.col("edited_tree")))
    return both.select(
        "doc_id",
        "n_chars",
        "edited_text",
        fingerprint(root(F.col("tree")), F.col("leaves")).alias("fingerprint"),
        fingerprint(root(F.col("edited_tree")), F.col("edited_leaves")).alias("edited_fingerprint"),
        likeness(F.col("leaves"), F.col("edited_leaves")).alias("near_edited"),
        likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"),
    )


def digests(edited: DataFrame) -> DataFrame:
    return edited.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
