"""Names shared across documents: spellings of one person over a whole corpus.

Two spellings belong together where the words of one are all among the words of the other, and are two at least; so do
spellings that hang together by such pairs. Spellings are first gathered to distinct sets of words. A set is looked for
under its two rarest words among the sets that hold both, so a name is compared with those that could contain it and
no others; pairs of words that very many sets hold are dealt over salts. Classes are found by labels that spread over
the pairs, each round a join and a minimum, with short cuts through the labels themselves; nothing is collected.

Defined results: null names are left out; case, accents, particles and the
order of words do not count; the longest spelling names a class, of equally long ones the first by place; a name of one
word or none is a class of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import scalars
from maskwright.functions.names import _skipped
from maskwright.functions.patterns import spaced
from maskwright.scratch import discard, materialize

#: Sets that hold a pair of words before their rows are dealt over salts, and rows a salt then gets.
HOT = 10_000


def words_of(name: Column) -> Column:
    """The distinct words of a name that tell people apart, sorted: without accents, case, final dots and particles."""
    parts = F.split(scalars.without_accents(F.lower(name)), spaced(r"\s+"))
    words = F.transform(parts, lambda w: F.regexp_replace(w, r"\.\z", ""))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(*sorted(_skipped())))))


def _pairs(words: Column) -> Column:
    """Every two words of a sorted array."""
    rest = lambda w, i: F.transform(F.slice(words, i + 2, F.size(words)), lambda v: F.struct(w.alias("a"), v.alias("b")))
    return F.flatten(F.transform(words, rest))


def contained(sets: DataFrame) -> DataFrame:
    """Pairs small, big of distinct sets (columns id, words) where all words of small, two at least, are in big."""
    counts = sets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ranked = sets.where(F.size("words") >= 2).select("id", "words", F.explode("words").alias("word")).join(counts, "word")
    rarest = ranked.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "word"))), 1, 2).alias("two"), F.first("words").alias("words"))
    key = F.array_sort(F.transform("two", lambda x: x["word"]))
    small = rarest.select(F.struct(key[0].alias("a"), key[1].alias("b")).alias("pair"), F.col("id").alias("small"), F.col("words").alias("few"))
    big = sets.where(F.size("words") >= 3).select(F.explode(_pairs(F.col("words"))).alias("pair"), F.col("id").alias("big"), F.col("words").alias("many"))
    hot = big.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("pair", F.ceil(F.col("n") / HOT).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    dealt = big.join(hot, "pair", "left").withColumn("salt", F.pmod(F.xxhash64("big"), salts).cast("int"))
    everywhere = small.join(hot, "pair", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    met = dealt.join(everywhere, ["pair", "salt"]).where(F.size("many") > F.size("few"))
    return met.where(F.size(F.array_except("few", "many")) == 0).select("small", "big")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and the smallest id that it hangs together with; edges have small and big, in any order.

    A round takes the least label of the neighbours and then the label of that label; it ends when no label changes.
    Every round is written, so lineage stays short and a lost executor costs one round.
    """
    both = materialize(edges.select(F.col("small").alias("x"), F.col("big").alias("y")).union(edges.select("big", "small")), "shared-edges")
    labels = materialize(nodes.select("id", F.col("id").alias("label")), "shared-labels")
    while True:
        near = both.join(labels, both["y"] == labels["id"]).groupBy("x").agg(F.min("label").alias("near"))
        least = labels.join(near, labels["id"] == near["x"], "left").select("id", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        of = labels.select(F.col("id").alias("root"), F.col("label").alias("further"))
        cut = least.join(of, least["label"] == of["root"], "left").select("id", "was", F.least("label", F.coalesce("further", "label")).alias("label"))
        after = materialize(cut, "shared-labels")
        changed = after.where("was != label").limit(1).count()
        discard(labels)
        labels = after.select("id", "label")
        labels._scratch_path = after._scratch_path
        if not changed:
            discard(both)
            return labels


def shared_names(names: DataFrame) -> DataFrame:
    """name, canonical, n_documents and n_spellings of every distinct spelling.

    names: doc, name, place; one row an occurrence, place ordering those of a document.
    """
    seen = names.where("name is not null").groupBy("name").agg(F.count_distinct("doc").alias("n_documents"), F.min(F.struct("doc", "place")).alias("first"))
    words = words_of(F.col("name"))
    alone = F.array(F.concat(F.lit("alone:"), F.col("name")))  # in no other set
    spelled = materialize(seen.withColumn("words", F.when(F.size(words) >= 2, words).otherwise(alone)), "shared-names")
    sets = materialize(spelled.select("words").distinct().select(F.sha2(F.array_join("words", " "), 256).alias("id"), "words"), "shared-sets")
    label = components(sets, contained(sets))
    one = spelled.withColumn("id", F.sha2(F.array_join("words", " "), 256)).join(label, "id")
    best = F.struct((-F.length("name")).alias("l"), F.col("first"), F.col("name"))
    chosen = one.groupBy("label").agg(F.min(best)["name"].alias("canonical"), F.count(F.lit(1)).alias("n_spellings"))
    return one.join(chosen, "label").select("name", "canonical", "n_documents", "n_spellings")
