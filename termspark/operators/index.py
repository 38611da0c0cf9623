"""A stored inverted index of terms, with a delta over it.

terms: acronym, ld_id, entity, pref_label, synonyms (array), properties (a map from names to arrays), ord, is_provisional.
The names of a term are its label, its synonyms and its property values, in lower case. An index has for each term the pieces
of its names: their runs of three characters (marked "c"; all of a shorter name), and the beginnings of their words (marked
"w"). It is written once, in buckets by piece, and its terms, with their words, in buckets by number. So a search shuffles
requests and hits, not the index.

Changes are a small index of their own, and a list of the terms that they replace or delete. Readers see the changes at once,
without a rebuild; `compact` writes base and changes as a new base.

All pieces of all names are many times the names. So terms that are searched once are scanned (`Names`): only pieces that
the searched texts have are counted and met, in the task that reads the name, and only counts and matches are shuffled. A few
texts are looked for in all names as they are. Names take changes as an index does: in a delta and a list, over a base that stays.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termspark.sources import bucketed, cut, discard

TERM = ["acronym", "ld_id", "entity", "pref_label", "synonyms", "properties", "ord", "is_provisional"]
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Kinds of matches, the best first.
KINDS = ("prefLabel", "synonym", "property")


#: Pieces of a text whose postings are intersected, and how many times the rarest one's postings the others may have.
PIECES, TIMES = 3, 4
#: Terms in a bucket of a delta.
DELTA_ROWS = 20_000
#: Bytes of texts that a scan holds in every task; more of them are searched by an index that is made for them.
HELD_BYTES = 16 << 20
#: So many texts at most are looked for in every name, rather than their pieces.
FEW_TEXTS = 16


def words(text: Column) -> Column:
    return F.split(text, NOT_WORD)


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters; of a shorter text, the text itself."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3))))


def pieces_of(names: DataFrame) -> DataFrame:
    """no and piece of names (no, name), some of them more than once."""
    last = F.greatest(F.length("name") - 2, F.lit(1))
    runs = names.select("no", "name", F.explode(F.sequence(F.lit(1), last)).alias("i")).select("no", F.concat(F.lit("c"), F.substring("name", F.col("i"), F.lit(3))).alias("piece"))
    word = names.select("no", F.explode(words(F.col("name"))).alias("word")).where("word <> ''")
    begun = word.select("no", "word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    return runs.unionByName(begun.select("no", F.concat(F.lit("w"), F.substring("word", F.lit(1), F.col("i"))).alias("piece")))


@dataclass(frozen=True)
class Part:
    """terms: TERM, no and `names`, for each kind of match an array of names (name, words); postings: piece, no; sizes: piece, n."""

    terms: DataFrame
    postings: DataFrame
    sizes: DataFrame


@dataclass(frozen=True)
class TermIndex:
    base: Part
    delta: Part | None = None
    gone: DataFrame | None = None  # acronym, ld_id of terms in the base that no longer count

    @property
    def parts(self) -> list[Part]:
        return [self.base] if self.delta is None else [self.base, self.delta]

    def terms(self) -> DataFrame:
        """TERM of all terms that count."""
        if self.delta is None:
            return self.base.terms.select(*TERM)
        return self.base.terms.join(self.gone, ["acronym", "ld_id"], "left_anti").select(*TERM).unionByName(self.delta.terms.select(*TERM))


@dataclass(frozen=True)
class Names:
    """Terms (TERM) that are searched by reading all of their names; the tables are written. delta and gone are as in an index."""

    table: DataFrame
    delta: DataFrame | None = None
    gone: DataFrame | None = None

    def terms(self) -> DataFrame:
        if self.delta is None:
            return self.table.select(*TERM)
        return self.table.join(self.gone, ["acronym", "ld_id"], "left_anti").select(*TERM).unionByName(self.delta.select(*TERM))


def told(terms: DataFrame) -> DataFrame:
    """terms with `names`: for each kind of match the lower-case names with their words."""
    values = F.flatten(F.map_values(F.coalesce("properties", F.create_map().cast("map<string,array<string>>"))))
    kinds = {"prefLabel": F.array("pref_label"), "synonym": F.coalesce("synonyms", F.array().cast("array<string>")), "property": values}
    own = lambda names: F.transform(F.array_compact(names), lambda n: F.struct(F.lower(n).alias("name"), words(F.lower(n)).alias("words")))
    return terms.withColumn("names", F.struct(*[own(names).alias(kind) for kind, names in kinds.items()]))


def _part(terms: DataFrame, sign: int, buckets: int | None) -> Part:
    """Numbers of the delta are negative, so that they differ from those of the base."""
    dealt = terms.select(*TERM).repartition(buckets or int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ld_id")
    known = cut(told(dealt).withColumn("no", sign * (F.monotonically_increasing_id() + 1)))
    every = F.concat(*[F.transform(F.col(f"names.{k}"), lambda n: n["name"]) for k in KINDS])
    postings = bucketed(pieces_of(known.select("no", F.explode(F.array_distinct(every)).alias("name"))), "piece", buckets, distinct=True)
    out = Part(bucketed(known, "no", buckets), postings, bucketed(postings.groupBy("piece").agg(F.count("*").alias("n")), "piece", buckets))
    discard(known)
    return out


def build(terms: DataFrame, buckets: int | None = None) -> TermIndex:
    """The index of a table of terms, one row for each (acronym, ld_id); written."""
    return TermIndex(_part(terms, 1, buckets))


def _delta(terms: DataFrame) -> Part:
    rows = cut(terms.select(*TERM))
    out = _part(rows, -1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + rows.count() // DELTA_ROWS))
    discard(rows)
    return out


def changed(index: TermIndex | Names, created: DataFrame, deleted: DataFrame) -> TermIndex | Names:
    """The index, or the names, after terms in `created` (TERM) came or were replaced and those in `deleted` (acronym, ld_id) went.

    Only the delta is written anew: changes of before that stay, and the new ones. That of an index has more buckets as it grows,
    so that no task writes more than some of it.
    """
    keys = ["acronym", "ld_id"]
    touched = created.select(*keys).unionByName(deleted.select(*keys)).distinct()
    if isinstance(index, Names):
        touched, rows = cut(touched), created.select(*TERM)
        if index.delta is None:
            return replace(index, delta=cut(rows), gone=touched)
        stays = index.delta.join(touched, keys, "left_anti").select(*TERM)
        return replace(index, delta=cut(stays.unionByName(rows)), gone=cut(index.gone.unionByName(touched).distinct()))
    if index.delta is None:
        return replace(index, delta=_delta(created), gone=cut(touched))
    stays = index.delta.terms.select(*TERM).join(touched, keys, "left_anti")
    return replace(index, delta=_delta(stays.unionByName(created.select(*TERM))), gone=cut(index.gone.unionByName(touched).distinct()))


def compact(index: TermIndex, buckets: int | None = None) -> TermIndex:
    """A base that has the changes in it."""
    return build(index.terms(), buckets)


def _short(index: TermIndex, texts: DataFrame) -> DataFrame:
    """text, ahead, piece: for a text of one or two characters all runs of names that have it."""
    runs = [p.sizes.where("piece LIKE 'c%'").select("piece") for p in index.parts]
    whole = runs[0] if len(runs) == 1 else runs[0].unionByName(runs[1]).distinct()
    inside = F.array_distinct(F.flatten(F.array(*[F.array(*[F.substring("piece", i, n) for i in range(2, 5 - n + 1)]) for n in (1, 2)])))
    return texts.join(whole.select("piece", F.explode(inside).alias("text")), "text").select("text", "ahead", "piece")


def candidates(index: TermIndex, texts: DataFrame) -> DataFrame:
    """texts (text, ahead), distinct: text, ahead, no of the terms that may match.

    A text meets the terms that have its rarest pieces, runs of three characters or with `ahead` its words; their postings are
    intersected. A text with a piece that no term has matches nothing.
    """
    mark = F.when(F.col("ahead"), "w").otherwise("c")
    pieces = F.filter(F.when(F.col("ahead"), F.array_distinct(words(F.col("text")))).otherwise(trigrams(F.col("text"))), lambda p: p != "")
    each = texts.where("ahead OR length(text) > 2").select("text", "ahead", F.size(pieces).alias("all"), F.explode(F.transform(pieces, lambda p: F.concat(mark, p))).alias("piece"))
    sized = [each.join(p.sizes, "piece") for p in index.parts]
    known = sized[0] if len(sized) == 1 else sized[0].unionByName(sized[1]).groupBy("text", "ahead", "all", "piece").agg(F.sum("n").alias("n"))
    own = known.groupBy("text", "ahead", "all").agg(F.array_sort(F.collect_list(F.struct("n", "piece"))).alias("found")).where("size(found) = all")
    few = F.slice(F.filter("found", lambda p: p["n"] <= TIMES * F.col("found")[0]["n"]), 1, PIECES)
    best = own.select("text", "ahead", F.size(few).alias("many"), F.explode(few).alias("p")).select("text", "ahead", "many", "p.piece")
    wanted = best.unionByName(_short(index, texts.where("NOT ahead AND length(text) < 3")).select("text", "ahead", F.lit(1).alias("many"), "piece"))
    met = [wanted.join(p.postings, "piece").select("text", "ahead", "many", "no") for p in index.parts]
    both = met[0] if len(met) == 1 else met[0].unionByName(met[1])
    return both.groupBy("text", "ahead", "no").agg(F.count("*").alias("n"), F.max("many").alias("many")).where("n >= many").select("text", "ahead", "no")


def found_in(names: Column) -> Column:
    """Whether one of the names contains the column `text`, or with `ahead`, has all words of `typed` but the last, which begins
    a word of that name."""
    first, last = F.slice("typed", F.lit(1), F.size("typed") - 1), F.element_at("typed", -1)
    begun = lambda n: (F.size(F.array_except(first, n["words"])) == 0) & F.exists(n["words"], lambda w: F.startswith(w, last))
    return F.when(F.col("ahead"), F.exists(names, begun)).otherwise(F.exists(names, lambda n: F.contains(n["name"], F.col("text"))))


def _every_name(terms: DataFrame) -> DataFrame:
    """terms with `_all`, all names of a term in lower case as one text."""
    values = F.flatten(F.map_values(F.coalesce("properties", F.create_map().cast("map<string,array<string>>"))))
    every = F.concat(F.array("pref_label"), F.coalesce("synonyms", F.array().cast("array<string>")), values)
    return terms.withColumn("_all", F.lower(F.array_join(every, "\n")))


def _read(terms: DataFrame, wanted: DataFrame, ahead: bool, long: int) -> DataFrame:
    """Columns of terms and of wanted (piece and others), for each term and each wanted piece of `long` characters that one of
    its names has, or with `ahead`, that begins one of its words, which then are of any length up to `long`.

    The names are taken as one text, which has to contain the columns of wanted that begin with `also`; a piece counts where it is
    for the first time. Which pieces are wanted is known in each task, by a hash, so that others go where they are made.
    """
    text, keep = _every_name(terms), [*terms.columns, *wanted.columns]
    held = F.broadcast(wanted.withColumnRenamed("piece", "_piece").withColumn("_key", F.xxhash64("_piece")))
    keep[len(terms.columns) + wanted.columns.index("piece")] = "_piece"
    # Not as an equality, which would be a second key of the join: by a long alone it is much faster.
    same = (F.xxhash64("piece") == F.col("_key")) & F.startswith(F.col("piece"), F.col("_piece")) & F.startswith(F.col("_piece"), F.col("piece"))
    for c in wanted.columns:
        if c.startswith("also"):
            same = same & F.contains("_all", c)
    if not ahead:
        last = F.greatest(F.length("_all") - (long - 1), F.lit(1))
        runs = text.withColumn("_at", F.explode(F.sequence(F.lit(1), last))).withColumn("piece", F.substring("_all", F.col("_at"), F.lit(long)))
        first = F.call_function("locate", F.col("_piece"), F.col("_all")) == F.col("_at")
        return runs.join(held, same & first).select(*keep).withColumnRenamed("_piece", "piece")
    each = text.withColumn("_words", words(F.col("_all"))).select("*", F.posexplode("_words").alias("_at", "_word")).where("_word <> ''")
    begun = each.withColumn("_n", F.explode(F.sequence(F.lit(1), F.least(F.length("_word"), F.lit(long))))).withColumn("piece", F.substring("_word", F.lit(1), F.col("_n")))
    first = F.array_position(F.transform("_words", lambda w: F.startswith(w, F.col("_piece"))), True) == F.col("_at") + 1
    return begun.join(held, same).where(first).select(*keep).withColumnRenamed("_piece", "piece")


def looked_through(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """text, ahead and TERM of the terms that may match a few texts (text, ahead): each text, or with `ahead` each of its words,
    is somewhere in the names. As in `candidates`, a text without words matches nothing with `ahead`."""
    typed = F.filter(words(F.col("text")), lambda w: w != "")
    asked = F.broadcast(texts.select("text", "ahead", typed.alias("_typed")).where("NOT ahead OR size(_typed) > 0"))
    there = F.when(F.col("ahead"), F.forall("_typed", lambda w: F.contains(F.col("_all"), w))).otherwise(F.contains("_all", "text"))
    return _every_name(terms.select(*TERM)).join(asked, there).select("text", "ahead", *TERM)


def scanned(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """text, ahead and TERM of the terms that may match texts (text, ahead; written), each pair once.

    As in `candidates`, a text with a piece that no term has matches nothing; the others meet what has their rarest piece, and
    two others, the longest ones.
    """
    length = F.least(F.length("text"), F.lit(3))
    own = F.filter(F.when(F.col("ahead"), F.array_distinct(words(F.col("text")))).otherwise(trigrams(F.col("text"))), lambda p: p != "")
    each = cut(texts.select("text", "ahead", F.when(F.col("ahead"), 0).otherwise(length).alias("kind"), F.size(own).alias("all"), F.explode(own).alias("piece")))
    kinds = {r["kind"]: r["long"] for r in each.groupBy("kind").agg(F.max(F.length("piece")).alias("long")).collect()}
    named = ["pref_label", "synonyms", "properties"]
    rows = lambda table, wanted: [_read(table, wanted.where(F.col("kind") == kind), kind == 0, long) for kind, long in kinds.items()]
    together = lambda parts: reduce(DataFrame.unionByName, parts)
    if not kinds:
        return terms.where("false").select(F.lit("").alias("text"), F.lit(False).alias("ahead"), *TERM)
    met = together(rows(terms.select(*named), each.select("kind", "piece").distinct()))
    sizes = cut(met.groupBy("kind", "piece").agg(F.count("*").alias("n")))
    best = each.join(sizes, ["kind", "piece"]).groupBy("text", "ahead", "kind", "all").agg(F.array_sort(F.collect_list(F.struct("n", "piece"))).alias("found"))
    rest = F.reverse(F.array_sort(F.transform(F.slice("found", 2, F.size("found")), lambda p: F.struct(F.length(p["piece"]).alias("n"), p["piece"].alias("piece")))))
    also = [F.coalesce(F.get(rest, F.lit(i))["piece"], F.lit("")).alias(f"also{i}") for i in (0, 1)]
    baits = cut(best.where("size(found) = all").select("text", "ahead", "kind", F.col("found")[0]["piece"].alias("piece"), *also))
    discard(each, sizes)
    return together(rows(terms.select(*TERM), baits)).select("text", "ahead", *TERM)


def matches(index: TermIndex | Names, texts: DataFrame) -> DataFrame:
    """text, ahead, match_type and TERM: the terms that match each text (lower case, trimmed, not empty), by their label, else a
    synonym, else a property value; each is checked on its names.

    The match is generated, as a filter on it would be pushed down and evaluate it again.
    """
    if isinstance(index, Names):
        texts = cut(texts.select("text", "ahead"))
        n, held = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
        if (held or 0) > HELD_BYTES:
            return matches(build(index.terms()), texts)
        met = looked_through if n <= FEW_TEXTS else scanned
        found = met(index.table, texts)
        if index.delta is not None:  # the hits are written, or what is gone would be taken from all names before the search
            stays = cut(found).join(index.gone, ["acronym", "ld_id"], "left_anti").select("text", "ahead", *TERM)
            found = stays.unionByName(met(index.delta, texts))
        both = told(found).withColumn("typed", words(F.col("text")))
    else:
        both = _indexed(index, texts)
    kind = F.coalesce(*[F.when(found_in(F.col(f"names.{k}")), k) for k in KINDS])
    return both.select("text", "ahead", *TERM, F.explode_outer(F.array(kind)).alias("match_type")).where("match_type IS NOT NULL")


def _indexed(index: TermIndex, texts: DataFrame) -> DataFrame:
    """text, ahead, typed, TERM and names of the candidates among the terms of an index."""
    met = candidates(index, texts).withColumn("typed", words(F.col("text")))
    rows = [met.join(index.base.terms, "no")]
    if index.delta is not None:
        rows = [rows[0].join(index.gone, ["acronym", "ld_id"], "left_anti"), met.join(index.delta.terms, "no")]
    return rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
