"""Line dedup by deletion neighbourhoods, in DataFrame functions only.

A line is its words (white space parts them). A line is dropped if an earlier line, by document and then by position, is within the edit bound
of it: the same words, or, as the bound is one edit for lines of ``min_words`` words or more and none under that, one word more, less or
changed between two such lines. Judged on the input; lines without words stay.

Equal lines are one class first, and the earliest of a class stands for it. Near lines: with at most one word edited, either the first or
the last half of the shorter line's words is untouched. So only classes that share such a half with another one emit their deletion
variants: all ways to leave out one word, and the line itself. Equal variants are joined through the earliest holder of each, which is one row
for a variant, so a variant held by very many lines makes no pairs. Each join is then verified on the words themselves.

The key of a variant is the exclusive or of a hash of each word with its place, so a line's keys all come from its prefixes in one pass over
its words. A document is known by its id and the hash of its text, never by its place among the rows, which may change when a lost
executor's work is done again.

Defined cases: a null text stays null and has no lines; an empty text has one line without words; a null doc_id comes before all others;
rows with the same id and the same text are one document and all get its result, of rows with the same id and other texts the one with
the smaller hash comes first; equal lines keep the earliest; very long lines have as many variants as words. Extra columns are passed
through whatever their names; n_lines, n_dropped among them are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.jobs import checkpoint, refuse_columns, written

BLANKS = "[\\x20\\x09-\\x0D]+"
#: Words of a line whose running sums are one array.
RUN = 256


def words_of(line: Column) -> Column:
    """The words, one blank between two."""
    odd = F.contains(line, F.lit("  "))
    for blank in "\t\v\f\r":
        odd = odd | F.contains(line, F.lit(blank))
    return F.trim(F.when(odd, F.regexp_replace(line, BLANKS, " ")).otherwise(line))


def without(words: Column, at: Column) -> Column:
    """The words but for the one at ``at`` (from 0); all, if it is -1."""
    return F.when(at < 0, words).otherwise(F.concat(F.slice(words, F.lit(1), F.greatest(at, F.lit(0))), F.slice(words, F.greatest(at, F.lit(0)) + 2, F.greatest(F.size(words) - at - 1, F.lit(0)))))


def variant_keys(words: Column) -> Column:
    """The keys of all variants: first of the line itself, then without each of its words in turn."""
    here, moved = F.transform(words, lambda w, j: F.xxhash64(w, j)), F.transform(words, lambda w, j: F.xxhash64(w, j - 1))
    none = F.lit(0).cast("long")
    together = lambda hashes: F.aggregate(hashes, none, lambda sum_, x: sum_.bitwiseXOR(x))
    step = F.zip_with(here, moved, lambda x, y: x.bitwiseXOR(y))
    # all words moved up by one; then one word after the other goes back to its place
    running = lambda hashes, first: F.aggregate(hashes, F.array(first), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1).bitwiseXOR(x))))
    # a long line in runs, each of which starts with what the runs before it come to, as a sum takes its whole array along
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    cut = lambda whole: F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / RUN).cast("int")), lambda k: F.slice(whole, k * RUN + 1, F.lit(RUN)))
    joined = lambda runs: F.flatten(F.zip_with(runs, F.slice(running(F.transform(runs, together), together(moved)), F.lit(1), F.size(runs)), lambda run, first: F.slice(running(run, first), F.lit(1), F.size(run))))
    parted = once(once(step, cut), joined)
    turns = F.when(F.size(words) <= RUN, running(step, together(moved))).otherwise(parted)
    left_out = F.zip_with(moved, turns, lambda x, y: F.coalesce(x, none).bitwiseXOR(y))
    return F.concat(F.array(together(here)), F.slice(left_out, F.lit(1), F.size(words)))


def duplicate_lines(texts: DataFrame, min_words: int) -> DataFrame:
    """(doc, copy, dropped array<int>): for each document of texts (doc, copy, text) that loses lines, which, from 0."""
    lines = texts.select("doc", "copy", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("norm", words_of(F.col("line"))).drop("line")
    n = F.when(F.col("norm") == "", 0).otherwise(F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "))) + 1)
    lines = lines.withColumn("n", n).filter("n > 0")
    half = lambda m, kind: F.xxhash64(F.lit(kind), m, F.call_function("substring_index", F.col("norm"), F.lit(" "), m if kind == "first" else -m))
    m, less = F.floor(F.col("n") / 2).cast("int"), F.floor((F.col("n") - 1) / 2).cast("int")
    kinds = [(kind, k) for kind in ("first", "last") for k in range(2)]
    halves = [f"{kind}{k}" for kind, k in kinds]
    # written once: the classes read it with the halves, the flags without
    keyed = written(lines.select(
        "doc", "copy", "pos", "n", F.xxhash64("norm").alias("h1"), F.crc32(F.col("norm").cast("binary")).alias("h2"),
        *[F.when((F.col("n") >= min_words) & ((m != less) if k else F.lit(True)), half(less if k else m, kind)).alias(f"{kind}{k}") for kind, k in kinds],
    ))
    classes = keyed.groupBy("h1", "h2").agg(F.min(F.struct("doc", "copy", "pos")).alias("at"), F.count(F.lit(1)).alias("held"), F.first("n").alias("n"), *[F.first(h).alias(h) for h in halves])
    # a number for each class, in the order of its earliest line
    classes = checkpoint(classes.orderBy("at").select(F.monotonically_increasing_id().alias("line"), "h1", "h2", "at.doc", "at.copy", "at.pos", "held", "n", *halves))

    # classes that share half of their words with another one
    long = classes.filter(F.col("n") >= min_words).select("line", F.explode(F.array(*halves)).alias("half")).filter("half IS NOT NULL")
    shared = long.groupBy("half").agg(F.min("line").alias("a"), F.max("line").alias("b")).filter("a < b").select("half")
    near = long.join(shared, "half").select("line").distinct().join(classes.select("line", "doc", "copy", "pos"), "line")
    wanted = checkpoint(near.groupBy("doc", "copy").agg(F.map_from_entries(F.collect_list(F.struct("pos", "line"))).alias("wanted")))
    same = texts["doc"].eqNullSafe(wanted["doc"]) & (texts["copy"] == wanted["copy"])
    found = texts.join(wanted, same).select(F.posexplode(F.split("text", "\n")).alias("pos", "text"), "wanted").withColumn("line", F.element_at("wanted", F.col("pos"))).filter("line IS NOT NULL")
    # rows that are one document find a line more than once
    held = checkpoint(found.select("line", F.split(words_of(F.col("text")), " ").alias("words")).groupBy("line").agg(F.first("words").alias("words")))

    # deletion variants as hashed keys; those that two lines share, through the earliest holder
    variants = checkpoint(held.select("line", F.posexplode(variant_keys(F.col("words"))).alias("i", "key")).select("line", (F.col("i") - 1).alias("i"), "key"))
    earliest = variants.groupBy("key").agg(F.min("line").alias("any"), F.max("line").alias("most"), F.min_by("i", "line").alias("any_i"), F.min(F.when(F.col("i") < 0, F.col("line"))).alias("whole")).filter("any < most").drop("most")
    met = checkpoint(variants.join(earliest, "key"))
    through_whole = met.filter("i >= 0 AND whole < line").select("line", "i", F.col("whole").alias("other"), F.lit(-1).alias("j"))
    as_whole = met.filter("i < 0 AND any < line").select("line", "i", F.col("any").alias("other"), F.col("any_i").alias("j"))
    place = met.filter("i >= 0").groupBy("key", "i").agg(F.min("line").alias("same"), F.max("line").alias("most")).filter("same < most").drop("most")
    changed = met.filter("i >= 0").select("line", "key", "i").join(place, ["key", "i"]).filter("same < line").select("line", "i", F.col("same").alias("other"), F.col("i").alias("j"))
    pairs = through_whole.unionByName(as_whole).unionByName(changed)
    a, b = held.select("line", F.col("words").alias("a")), held.select(F.col("line").alias("other"), F.col("words").alias("b"))
    verified = pairs.join(a, "line").join(b, "other").filter(without(F.col("a"), F.col("i")) == without(F.col("b"), F.col("j"))).select("line").distinct()

    kept = classes.select("line", "h1", "h2", "held", F.struct("doc", "copy", "pos").alias("kept")).join(verified.withColumn("near", F.lit(True)), "line", "left").filter("held > 1 OR near").drop("line", "held")
    flagged = keyed.select("doc", "copy", "pos", "h1", "h2").join(checkpoint(kept), ["h1", "h2"])
    drop = (F.struct("doc", "copy", "pos") != F.col("kept")) | F.coalesce("near", F.lit(False))
    return flagged.filter(drop).groupBy("doc", "copy").agg(F.collect_set("pos").alias("dropped"))


def dedup_lines(docs: DataFrame, min_words: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, with the text as its kept lines, and n_lines long, n_dropped long."""
    refuse_columns(docs, "n_lines", "n_dropped")
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]).alias("rest") if len(docs.columns) > 2 else F.lit(None).alias("rest"), F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    given = given.withColumn("copy", F.xxhash64("text"))
    drops = checkpoint(duplicate_lines(given.select("doc", "copy", "text"), min_words).withColumnsRenamed({"doc": "of", "copy": "of_copy"}))
    joined = given.join(drops, F.col("doc").eqNullSafe(F.col("of")) & (F.col("copy") == F.col("of_copy")), "left")
    parts = F.split("text", "\n")
    # as a map, so that a document of very many lines looks each one up at once
    gone = F.map_from_arrays("dropped", F.transform("dropped", lambda _: F.lit(True)))
    kept = F.filter(parts, lambda _, i: F.element_at("gone", i).isNull())
    text = F.when(F.col("dropped").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text"))
    own = {id_col: F.col("doc"), text_col: text}
    columns = [own.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns]
    return joined.withColumn("gone", gone).select(*columns, F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))
