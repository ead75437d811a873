"""Secret scans by a battery of randomness tests, in DataFrame functions only.

Three kinds of spans are found by their form: assignments to a secret's name, access keys and long hexadecimal
runs. Beyond these every run of at least ``LEAST`` encoding characters is a candidate. Its encoding is inferred from the
characters in it, and it is tested for being random in that alphabet: chi-squared uniformity, the number of
runs above and below the alphabet's middle, and serial correlation of neighbours. It counts as random where
none of the three rejects that, at ``REJECT`` after correction for three tests.

Short strings pass such tests whatever they are. So each candidate also gets the probability that ordinary text of its
length would come out as even: under that, chi-squared has a noncentrality that grows with the length. Over a
document's candidates these probabilities go through the Benjamini-Hochberg procedure at ``RATE``, and only
discoveries are reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import let, running, text_or_empty

LEAST = 20
REJECT = 0.001
RATE = 0.01

# The patterns of the kinds that always count, and the least length of what they must hold.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

#: '=' pads the end only, so one in front of a value (NAME=value) begins a new candidate. The look ahead spares short words;
#: what it lets through is held against LEAST with its padding.
_CANDIDATE = f"(?=[A-Za-z0-9+/=_-]{{{LEAST}}})[A-Za-z0-9+/_-]+=*"
#: Encoding, pattern of the strings in it, alphabet, and the chance that two characters of ordinary text
#: in it are equal. The first that fits is taken.
ENCODINGS = (
    ("hex", "^(?=.*[0-9].*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]+$", "0123456789abcdef", 0.125),
    ("base32", "^(?=.*[2-7].*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.085),
    ("base36", "^(?=.*[0-9].*[0-9])(?=.*[a-z])[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 0.075),
    ("base64", "^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.065),
)

_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _matches(text: Column, pattern: str, group: int) -> Column:
    """(start, end, part) of each match in code points, end exclusive; part: what the group holds."""
    kind = "array<struct<start:int,end:int,part:string>>"
    sizes = F.struct(
        F.transform(F.split(text, pattern, -1), F.length).alias("before"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length).alias("found"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
    )

    def placed(x: Column) -> Column:
        at = running(F.zip_with(F.slice(x["before"], 1, F.size(x["found"])), x["found"], lambda b, f: b + f), lambda a, b: a + b)

        def one(start: Column, i: Column) -> Column:
            start = start + x["before"][i]
            return F.struct(start.alias("start"), (start + x["found"][i]).alias("end"), x["part"][i].alias("part"))

        return F.transform(at, one).cast(kind)

    none = F.array().cast(kind)
    return F.when(text.rlike(pattern), let(sizes, lambda x: F.when(F.size(x["found"]) > 0, placed(x)).otherwise(none))).otherwise(none)


def _named(matches: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"))).cast(_SPAN)


def _normal(z: Column) -> Column:
    """The normal distribution function, to within 0.0002."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.070566 * z * z * z)))


def _two_sided(z: Column) -> Column:
    return 2 * _normal(-F.abs(z))


def _tests(s: Column) -> Column:
    """Of a string: (random, ordinary), the combined probability of being random and that of ordinary text being as
    even. Nulls where it is in no encoding."""

    def tested(x: Column) -> Column:
        n, k = F.length(x["s"]).cast("double"), F.length(x["letters"]).cast("double")
        values = F.transform(F.split(x["s"], ""), lambda c: F.instr(x["letters"], c) - 1)
        counts = F.transform(F.array_distinct(F.split(x["s"], "")), lambda c: n - F.length(F.replace(x["s"], c, F.lit(""))))
        squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
        chi = k / n * squares - n
        # Wilson and Hilferty: the cube root of chi-squared over its degrees of freedom is about normal.
        d = k - 1
        even = _two_sided((F.pow(F.greatest(chi, F.lit(0.0)) / d, 1 / 3) - (1 - 2 / (9 * d))) / F.sqrt(2 / (9 * d)))

        def sequence(v: Column) -> Column:
            high = F.aggregate(v, F.lit(0.0), lambda a, c: a + F.when(c >= k / 2, 1.0).otherwise(0.0))
            low = n - high
            pairs = F.sequence(F.lit(1), F.size(v) - 1)
            runs = F.aggregate(pairs, F.lit(1.0), lambda a, i: a + F.when((v[i] >= k / 2) != (v[i - 1] >= k / 2), 1.0).otherwise(0.0))
            mean = 2 * high * low / n + 1
            sd = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))

            def correlation(middle: Column) -> Column:
                spread = F.aggregate(v, F.lit(0.0), lambda a, c: a + (c - middle) * (c - middle))
                joint = F.aggregate(pairs, F.lit(0.0), lambda a, i: a + (v[i] - middle) * (v[i - 1] - middle))
                return F.try_divide(joint, spread) * F.sqrt(n)

            serial = let(F.aggregate(v, F.lit(0.0), lambda a, c: a + c) / n, correlation)
            return F.least(_two_sided((runs - mean) / sd), _two_sided(F.coalesce(serial, F.lit(1e3))))

        extra = n * (k * x["equal"] - 1)
        ordinary = _normal((chi - (d + extra)) / F.sqrt(2 * d + 4 * extra))
        return F.struct(F.least(F.lit(1.0), 3 * F.least(even, let(values, sequence))).alias("random"), ordinary.alias("ordinary"))

    found = F.lit(None).cast("struct<s:string,letters:string,equal:double>")
    for name, pattern, letters, equal in reversed(ENCODINGS):
        plain = F.lower(s) if name == "hex" else F.translate(F.rtrim(s, F.lit("=")), "_-", "/+")
        found = F.when(s.rlike(pattern), F.struct(plain.alias("s"), F.lit(letters).alias("letters"), F.lit(equal).alias("equal"))).otherwise(found)
    return let(found, lambda x: F.when(x.isNotNull(), tested(x)))


def _discoveries(text: Column) -> Column:
    """Spans of the candidates that are random, by Benjamini and Hochberg over those of one document."""
    long = F.filter(_matches(text, _CANDIDATE, 0), lambda m: F.length(m["part"]) >= LEAST)
    tried = F.filter(F.transform(long, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), _tests(m["part"]).alias("p"))), lambda m: m["p"].isNotNull())

    def kept(all_: Column) -> Column:
        ordered = F.sort_array(F.transform(all_, lambda m: m["p"]["ordinary"]))
        limit = F.array_max(F.transform(ordered, lambda p, i: F.when(p <= RATE * (i + 1) / F.size(all_), p).otherwise(F.lit(-1.0))))
        return let(limit, lambda most: F.filter(all_, lambda m: (m["p"]["ordinary"] <= most) & (m["p"]["random"] >= REJECT)))

    return let(tried, lambda x: F.when(F.size(x) > 0, _named(let(x, kept), "random")).otherwise(F.array().cast(_SPAN)))


def _outside(found: Column, base: Column) -> Column:
    """Those found spans that lie in none of base's: by start, a span lies in one if the largest end so far is beyond its own."""
    both = F.sort_array(F.concat(base, found))
    new = F.lit(KINDS.index("random"))

    def kept(spans: Column) -> Column:
        ends = running(F.transform(spans, lambda s: F.when(s["rank"] < new, s["end"]).otherwise(F.lit(0))), F.greatest)
        return let(ends, lambda e: F.filter(spans, lambda s, i: (s["rank"] == new) & (e[i] < s["end"])))

    return let(both, kept)


def scan(docs: DataFrame) -> DataFrame:
    """docs with ``base`` and ``spans``: arrays of (start, rank, end, kind) in code points, end exclusive, by start and
    then by kind. ``spans`` adds to ``base`` the random strings that lie in none of its spans.

    All columns of docs stay; columns of docs with one of these two names are replaced. A null text counts as an empty one
    and has no spans. Rows are independent, repeated ones included. Nothing is shuffled.
    """
    t = text_or_empty()
    assign = _named(F.filter(_matches(t, ASSIGN, 2), lambda m: F.length(m["part"]) >= 8), "assign")
    base = F.sort_array(F.concat(assign, _named(_matches(t, ACCESS, 0), "access"), _named(_matches(t, HEX, 0), "hex")))
    found = let(base, lambda b: F.struct(b.alias("base"), F.sort_array(F.concat(b, _outside(_discoveries(t), b))).alias("spans")))
    rest = [c for c in docs.columns if c not in ("base", "spans")]
    out = docs.select(*rest, found.alias("__found"))
    return out.select(*rest, F.col("__found.base").alias("base"), F.col("__found.spans").alias("spans"))


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(scanned: DataFrame) -> DataFrame:
    """scan's rows as counts, a digest of the base spans and a list of all."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(F.col("doc_id").cast("long").alias("doc_id"), *map(count, KINDS[:3]), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def redacted(scanned: DataFrame) -> DataFrame:
    """scan's rows with every span of the text replaced by a marker; spans that touch or overlap share one. A null text stays null."""
    t = text_or_empty()

    def pieces(found: Column) -> Column:
        """What each span leaves of the text before it, and its marker. A block of spans looks into its own part of the text,
        as finding a place takes time with what lies before it."""
        width = F.ceil(F.sqrt(F.size(found))).cast("int")

        def block(at: Column) -> Column:
            here = F.slice(found, at, width)
            first = here[0]["before"]
            part = F.struct(first.alias("at"), F.substring(t, first + 1, F.greatest(F.element_at(here, -1)["start"] - first, F.lit(0))).alias("text"))

            def piece(p: Column, s: Column) -> Column:
                gap = F.concat(F.substring(p["text"], s["before"] - p["at"] + 1, s["start"] - s["before"]), F.lit("[REDACTED-"), s["kind"], F.lit("]"))
                return F.when((s["start"] > s["before"]) | s["first"], gap).otherwise("")

            return let(part, lambda p: F.array_join(F.transform(here, lambda s: piece(p, s)), ""))

        return F.array_join(F.transform(F.sequence(F.lit(1), F.size(found), width), block), "")

    placed = F.zip_with("spans", running(F.transform("spans", lambda s: s["end"]), F.greatest), lambda s, e: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), e.alias("before")))
    placed = F.transform(placed, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["before"].alias("before"), (i == 0).alias("first")))
    tail = F.substring(t, F.array_max(F.transform("spans", lambda s: s["end"])) + 1, F.length(t))
    joined = F.concat(let(placed, pieces), tail)
    return scanned.withColumn("text", F.when(F.size("spans") > 0, joined).otherwise(F.col("text"))).drop("base", "spans")
