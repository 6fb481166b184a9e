"""Personal data by patterns, checksums and context (operator 7).

Regular expressions propose spans, validators (ranges, digit counts, Luhn,
mod-97) confirm them, and context words nearby adjust the score.  Everything is
SQL functions: the matches of a pattern and the pieces of the text between them
give, by running sums of their lengths, each match's code point span.

The patterns are written so that no text takes more than linear time or deep
recursion: runs are possessive, and a match can only begin where a run does or
where the match before ended.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters at either side of a span in which context words count.
NEAR = 40
#: Spans of a kind that needs context are kept from this score on.
LEAST = 0.5
#: Matches whose positions are summed in one go; keeps running sums linear in their number.
RUN = 128


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: its pattern, validator, context words and scores."""

    name: str
    pattern: str
    needs: str  # a string that each text with a match contains, or ""
    context: str
    score: float  # of a confirmed span
    bonus: float = 0.1  # with a context word nearby
    base: bool = True  # kept whatever its score

    def valid(self, match: Column) -> Column:
        digits = F.regexp_replace(match, "[^0-9]", "")
        if self.name == "ip":
            return match.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
        if self.name == "card":
            return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
        if self.name == "phone":
            return F.length(digits).between(8, 15)
        if self.name == "secret":  # letters and at least 4 digits
            return match.rlike("[A-Za-z]") & (F.length(digits) >= 4)
        if self.name == "iban":
            return mod97(F.regexp_replace(match, " ", "")) == 1
        return F.lit(True)


def mod97(code: Column) -> Column:
    """The remainder by 97 of an account number, its first four characters moved to the end, letters as 10 to 35."""
    turned = F.split(F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4)), "")
    value = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), lambda s, c: (s * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", r"e-?mail|mailto|contact|write|reach", 0.9),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", r"\bip\b|address|host|server|login", 0.7),
    Kind("card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){15,}+", "", r"card|visa|master|credit|debit|payment|cvv", 0.8),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", r"phone|tel|call|mobile|fax|whatsapp", 0.7),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", r"iban|account|bank|konto|cuenta|compte", 0.8, base=False),
    Kind("secret", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,256}+(?![A-Za-z0-9_-])", "", r"token|secret|api[_ -]?key|access[_ -]?key|password|passwd|credential|bearer|private[_ -]key", 0.2, 0.5, base=False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-", r"ssn|social security", 0.3, 0.5, base=False),
)


def running_sums(steps: Column) -> Column:
    """The running sums of an array of longs."""
    n = F.size(steps)
    add = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"] + x)).alias("out"))
    none = F.expr("cast(array() as array<bigint>)")
    start = lambda at: F.struct(at.cast("long").alias("at"), none.alias("out"))
    total = lambda run: F.aggregate(run, F.lit(0).cast("long"), lambda s, x: s + x)
    runs = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / RUN).cast("int")), lambda b: F.slice(steps, b * RUN + 1, F.lit(RUN)))
    before = F.aggregate(F.transform(runs, total), start(F.lit(0)), add)["out"]
    sums = F.flatten(F.transform(runs, lambda run, b: F.aggregate(run, start(F.when(b > 0, F.element_at(before, F.greatest(b, F.lit(1)))).otherwise(0)), add)["out"]))
    return F.when(n > 0, sums).otherwise(none)


def _steps(matches: Column, gaps: Column) -> Column:
    """For each match, the characters between its start and that of the match before."""
    return F.transform(matches, lambda _, j: (F.length(F.element_at(gaps, j + 1)) + F.when(j > 0, F.length(F.element_at(matches, F.greatest(j, F.lit(1))))).otherwise(0)).cast("long"))


def _spans(k: Kind, matches: Column, gaps: Column, starts: Column) -> Column:
    """The confirmed spans of a kind."""

    def span(x: Column, j: Column) -> Column:
        around = F.concat(F.substring(F.element_at(gaps, j + 1), -NEAR, NEAR), F.lit(" "), F.substring(F.element_at(gaps, j + 2), 1, NEAR))
        score = F.lit(k.score) + F.when(F.lower(around).rlike(k.context), k.bonus).otherwise(0.0)
        at = F.element_at(starts, j + 1)
        return F.struct(F.lit(k.name).alias("kind"), at.alias("start"), (at + F.length(x)).alias("end"), score.alias("score"), x.alias("text"))

    kept = F.filter(F.transform(matches, span), lambda x: k.valid(x["text"]) & (F.lit(True) if k.base else x["score"] >= LEAST))
    return F.when(F.size(matches) > 0, kept).otherwise(F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint,score:double,text:string>>)"))


def find_personal_data(docs: DataFrame, *, kinds: tuple[Kind, ...] = KINDS, keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (doc_id), text, and spans of personal data in text.

    spans is an array of (kind, start, end, score, text): by kind in the order
    of `kinds`, then by start; code points, end exclusive.  Matches of a kind are
    leftmost and do not overlap; those that fail their validator are dropped.
    Kinds that are not base need a score of LEAST.  A null or empty text has no
    spans; rows repeat as they come; other columns are ignored.
    """
    keep = ["doc_id"] if keep is None else keep
    text = F.coalesce(F.col("text"), F.lit(""))
    # what lies between matches comes with them, so that all else is sums of lengths
    raw = docs.select(*keep, text.alias("text"))
    for i, k in enumerate(kinds):
        has = F.col("text").contains(k.needs) if k.needs else F.col("text").rlike("[0-9]")
        raw = raw.withColumn(f"_m{i}", F.when(has, F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))))
    for i, k in enumerate(kinds):
        raw = raw.withColumn(f"_g{i}", F.when(F.size(f"_m{i}") > 0, F.split("text", k.pattern, -1)))
    for i in range(len(kinds)):
        m = F.col(f"_m{i}")
        raw = raw.withColumn(f"_s{i}", F.when(F.size(m) > 0, running_sums(_steps(m, F.col(f"_g{i}")))))
    found = [_spans(k, F.col(f"_m{i}"), F.col(f"_g{i}"), F.col(f"_s{i}")) for i, k in enumerate(kinds)]
    return raw.select(*keep, "text", F.concat(*found).alias("spans"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """find_personal_data() with `redacted`: the text with each span replaced by <kind>, the longer of overlapping spans."""
    out = find_personal_data(docs, **options)
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("to"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        piece = F.substring(F.col("text"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        return F.when(x["start"] >= s["at"], F.struct((-x["to"]).alias("at"), F.concat(s["out"], piece, F.lit("<"), x["kind"], F.lit(">")).alias("out"))).otherwise(s)

    done = F.aggregate(ordered, start, step)
    return out.withColumn("_d", done).withColumn("redacted", F.concat("_d.out", F.substring(F.col("text"), (F.col("_d.at") + 1).cast("int"), F.length("text")))).drop("_d")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    base, added = ([k.name for k in KINDS if k.base == b] for b in (True, False))
    named = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    found = find_personal_data(docs).select("doc_id", "spans")
    kinds = F.transform("spans", lambda x: x["kind"])
    counts, more = ([(F.size(kinds) - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{n}") for n in names] for names in (base, added))
    digest = F.sha2(F.concat_ws(",", F.transform(F.filter("spans", lambda x: x["kind"].isin(base)), named)), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), F.concat_ws(",", F.transform("spans", named)).alias("spans"), *more, F.size("spans").cast("long").alias("n_spans"), F.aggregate("spans", F.lit(0.0), lambda s, x: F.greatest(s, x["score"])).alias("score"))
