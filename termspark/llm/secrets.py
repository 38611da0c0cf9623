"""Secret scans with multipart credential linking, with DataFrame operations only.

Base kinds (`assign`, `access`, `hex`) are reported wherever they match. Three weak kinds are candidates only: `ident` (a
login, client or key id that is assigned), `opaque` (a long token of mixed letters and digits) and `endpoint` (a URL or an
IPv4 address). A weak candidate is reported when parts that complement it lie in its scope, which is the same document
within WINDOW code points: an identifier needs a secret, a secret needs an identifier, an endpoint needs both.

Positions come from marked texts: one regexp_replace puts a control character before and behind each match, and the
lengths of the parts between the marks add up to offsets in code points. Those control characters are first replaced, one
for one, by another one that no pattern can match, so offsets stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termspark.llm.common import cut, row_key, table

#: (kind, pattern before the counted part, counted part, least characters of the counted part), in the order of listing.
BASE = (
    ("assign", r"((?=[pPsStTaA])(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)", r"([A-Za-z0-9+/_.=-]+)", 6),
    ("access", r"()", r"(AKIA[A-Z0-9]+)", 20),
    ("hex", r"()", r"([0-9a-f]+)", 24),
)
WEAK = (
    ("ident", r"((?=[uUlLcCaA])(?i:user(?:name)?|login|client_?id|account|access_?key_?id)[\"']?\x20*[:=]\x20*[\"']?)", r"([A-Za-z0-9@._-]+)", 3),
    ("opaque", r"()", r"((?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,})", 20),
    ("endpoint", r"()", r"((?:https?://[A-Za-z0-9./:_?&=%-]+|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])))", 7),
)
KINDS = [k for k, *_ in (*BASE, *WEAK)]
#: Which role a kind plays in a credential.
ROLES = {"access": "id", "ident": "id", "assign": "secret", "hex": "secret", "opaque": "secret", "endpoint": "endpoint"}
WINDOW = 200
#: Matches of a text whose offsets are added up at a time.
CHUNK = 64


def marked(text: Column, head: str, body: str) -> Column:
    """The text cut before each match; each part but the first is head, mark, body, mark, rest."""
    return F.split(F.regexp_replace(text, head + body, "\x01$1\x02$2\x03"), "\x01")


def spans(parts: Column, kind: int, least: int) -> Column:
    """Array of (start, end, kind) of the matches whose body has `least` characters; ends are exclusive.

    Parts are taken in chunks: where each chunk starts comes from the chunks' lengths, and within a chunk spans are appended
    to a short array. Appending all to one array would copy it for every match.
    """
    chunks = F.transform(F.sequence(F.lit(2), F.size(parts), F.lit(CHUNK)), lambda i: F.slice(parts, i, CHUNK))
    length = lambda n, part: n + F.length(part) - 2
    sizes = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), length))
    begins = F.aggregate(sizes, F.array(F.length(parts[0])), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")

    def step(acc: Column, part: Column) -> Column:
        before = F.length(F.substring_index(part, "\x02", 1))
        to_end = F.length(F.substring_index(part, "\x03", 1)) - 1
        span = F.struct(acc["at"].alias("start"), (acc["at"] + to_end).alias("end"), F.lit(kind).alias("kind"))
        found = F.when(to_end - before >= least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct((acc["at"] + F.length(part) - 2).alias("at"), found.alias("found"))

    each = F.zip_with(chunks, F.slice(begins, F.lit(1), F.size(chunks)), lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none.alias("found")), step, lambda acc: acc["found"]))
    return F.when(F.size(parts) > 1, F.flatten(each)).otherwise(none)


def joined(found: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def in_order(found: Column) -> Column:
    """By start, then kind as listed. A scan finds no span twice, and a link is no span of the base, so none is repeated."""
    return F.transform(F.sort_array(F.transform(found, lambda s: F.struct(s["start"], s["kind"], s["end"]))), lambda s: F.struct(s["start"], s["end"], s["kind"]))


def scan(docs: DataFrame) -> DataFrame:
    """key, doc_id, base and weak: the spans of each document, before linking; written once, so that texts are scanned once."""
    clean = docs.select("doc_id", "text", F.regexp_replace(F.coalesce("text", F.lit("")), "[\x01-\x03]", "\x04").alias("t"))
    every = (*BASE, *WEAK)
    cuts = clean.select("doc_id", row_key("doc_id", "text").alias("key"), *[marked(F.col("t"), head, body).alias(k) for k, head, body, _ in every])
    found = [spans(F.col(k), n, least) for n, (k, _, _, least) in enumerate(every)]
    return cut(cuts.select("key", "doc_id", in_order(F.concat(*found[: len(BASE)])).alias("base"), in_order(F.concat(*found[len(BASE) :])).alias("weak")))


def linked(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """key and `linked`: the weak spans with complementary parts in their scope.

    An interval join: every part is dealt to the bins of its start and of its end, a weak span looks into the bins that its
    scope touches. A part in scope ends in it (before the span) or starts in it (behind the span), however long it is. Spans
    of a kind don't overlap, so a bin holds a bounded number of them, however many a document has.
    """
    role = F.element_at(F.array(*[F.lit(ROLES[k]) for k in KINDS]), F.col("s.kind") + 1)
    parts = (
        found.where(F.size("weak") > 0)
        .select("key", F.explode(F.concat("base", "weak")).alias("s"))
        .select("key", "s", role.alias("role"))
    )
    weak = parts.where(F.col("s.kind") >= len(BASE))
    looks = weak.select("key", "s", "role", F.explode(F.sequence(F.floor((F.col("s.start") - window) / window), F.floor((F.col("s.end") + window) / window))).alias("bin"))
    offers = parts.select("key", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("role").alias("other"), F.explode(F.array_distinct(F.array(F.floor(F.col("s.start") / window), F.floor(F.col("s.end") / window)))).alias("bin")).distinct()
    apart = F.greatest(F.col("start") - F.col("s.end"), F.col("s.start") - F.col("end"))
    near = looks.join(offers, ["key", "bin"]).where((F.col("other") != F.col("role")) & (apart <= window) & (apart >= 0))
    met = near.groupBy("key", "s", "role").agg(F.max(F.col("other") == "id").alias("id"), F.max(F.col("other") == "secret").alias("secret"))
    good = met.where("(role = 'id' AND secret) OR (role = 'secret' AND id) OR (role = 'endpoint' AND id AND secret)")
    return good.groupBy("key").agg(F.collect_list("s").alias("linked"))


def find_secrets(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, base, all: the base spans and all reported spans of each document, in order, as (start, end, kind number).

    A null text counts as empty. Repeated rows get equal results each; rows with one doc_id but different texts do not mix;
    a null doc_id is allowed. Other columns are ignored. Texts may be of any length.
    """
    found = scan(docs)
    more = linked(found, window)
    both = found.join(more, "key", "left")
    every = F.when(F.col("linked").isNull(), F.col("base")).otherwise(in_order(F.concat("base", F.coalesce("linked", F.expr("array()")))))
    return both.select("doc_id", "base", every.alias("all"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, (kind, *_) in enumerate(BASE)]
    return found.select("doc_id", *count, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))
