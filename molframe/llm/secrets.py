"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Two first-order models over the same alphabet give every transition a log-likelihood ratio; a token's score is the sum
over its transitions. The models are trained from labelled samples (text, is_random): what the fixed patterns find in
the corpus against the words of the corpus, with samples made by rule beside them. A part of the samples is held out, and
from it come the thresholds, with the precision and recall that they have there. Transitions are counted in Spark; what reaches
the driver is one table of alphabet x alphabet counts and one of scores in steps. Everything runs on built-in functions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._runtime import settle

# The base patterns, in the order in which spans of equal start are listed, and their least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Shorter tokens hold too few transitions to be told from names; only the fixed patterns find secrets in them. Tokens that are
#: plain words (letters, the first perhaps a capital) are judged from WORD_LEAST characters on.
TOKEN_LEAST, WORD_LEAST = 12, 20


def _tokens(marks: str) -> str:
    """Pattern of whole runs of letters, digits and ``marks`` that are judged."""
    run = f"[A-Za-z0-9{marks}]"
    return f"(?<!{run})(?:{run}{{{WORD_LEAST},}}|(?={run}{{{TOKEN_LEAST}}})[A-Z]?[a-z]*[A-Z0-9{marks}]{run}*)"


TOKEN = _tokens("+/_=-")
#: Parts of a token between the marks of paths and assignments.
PART, PART_MARKS = _tokens("+_-"), ("/", "=")
#: Documents whose words, and whose base spans, train the models, about (chosen by a hash of id and text).
WORD_DOCUMENTS, SPAN_DOCUMENTS = 2_000, 20_000
#: Random strings made for training, per kind.
RANDOM_STRINGS = 2000
#: One sample in so many is held out for the thresholds.
HELD_OUT = 4
#: Share of the held-out tokens above the thresholds that must be random.
PRECISION = 0.999
#: Steps in which thresholds are sought, of the mean ratio per transition and of the sum; a token needs both.
MEAN_STEP, SUM_STEP = 0.05, 1.0
#: The thresholds are these at least; a sum of 16 means odds of nine million to one.
MEAN_LEAST, SUM_LEAST = 0.2, 16.0

_STEMS = (
    "account address array async auth backup base batch block buffer build cache call channel check class client code "
    "column command config connect content context control copy count create current data default delete device "
    "dialog directory document domain download element email enable engine entry error event export factory field "
    "file filter format function global group handle header height image import index input instance item label "
    "layer layout length level library list load local manager member memory message method mode model module name "
    "network node number object offset option order output package page panel param parent path pattern point policy"
).split()


def _hits(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _spans(text: Column, kind: str, rank: int, pattern: str, kept) -> Column:
    """Array of (start, rank, end, kind, hit) for the leftmost non-overlapping hits for which ``kept(hit)`` holds.

    Gaps between hits and hits themselves alternate, so their lengths give the places, in code points. Hits are gone through
    in runs, for an appended array is copied: so the work is far from the square of their number.
    """
    none = F.array().cast(f"array<{_SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(x["gap"])
        end = begin + F.char_length(F.coalesce(x["hit"], F.lit("")))
        one = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.when(x["hit"].isNotNull() & kept(x["hit"]), F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def of_pairs(pairs: Column) -> Column:
        def run(acc: Column, first: Column) -> Column:
            done = F.aggregate(F.slice(pairs, first, _RUN), F.struct(acc["at"].alias("at"), none.alias("out")), step)
            return F.struct(done["at"].alias("at"), F.array_append(acc["runs"], done["out"]).alias("runs"))

        begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("runs"))
        return F.aggregate(F.sequence(F.lit(1), F.size(pairs), F.lit(_RUN)), begin, run, lambda acc: F.flatten(acc["runs"]))

    def of_hits(hits: Column) -> Column:
        both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"))
        return F.when(F.size(hits) == 0, none).otherwise(_let(both, of_pairs))

    return _let(_hits(text, pattern), of_hits)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_SPAN = "struct<start:int,rank:int,end:int,kind:string,hit:string>"
#: Hits in a run.
_RUN = 512


@dataclass(frozen=True)
class MarkovRatio:
    """Log-likelihood ratios of transitions, row-major over ALPHABET; positive speaks for a random string.

    A token is random from ``least_mean`` per transition and ``least_sum`` on; ``precision`` and ``recall`` are those of this
    rule over the held-out samples, null where nothing was held out.
    """

    table: tuple[float, ...]
    least_mean: float = 0.5
    least_sum: float = SUM_LEAST
    precision: float | None = None
    recall: float | None = None

    def score(self, token: Column) -> Column:
        """Sum of the ratios over the transitions of ``token`` (characters of ALPHABET only)."""
        size = len(ALPHABET)
        text = ",".join(f"{x:.6f}" for x in self.table)
        ratios = F.expr(f"cast(split('{text}', ',') as array<double>)")  # folded into one literal
        codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
        total = lambda c: F.aggregate(
            F.zip_with(c, F.slice(c, 2, F.size(c)), lambda a, b: F.coalesce(F.get(ratios, a * size + b), F.lit(0.0))),
            F.lit(0.0),
            lambda s, x: s + x,
        )
        return F.get(F.transform(F.array(codes), total), F.lit(0))


def ordinary_identifiers(spark: SparkSession) -> DataFrame:
    """Labelled samples made by rule: pairs of common stems in the usual spellings of identifiers, paths and keys."""
    stems = F.array(*[F.lit(s) for s in _STEMS])
    pair = spark.range(len(_STEMS) ** 2).select(
        F.get(stems, (F.col("id") % len(_STEMS)).cast("int")).alias("a"),
        F.get(stems, F.floor(F.col("id") / len(_STEMS)).cast("int")).alias("b"),
    )
    spelt = F.array(
        F.concat_ws("_", "a", "b"), F.concat("a", F.initcap("b")), F.concat_ws("-", "a", "b"),
        F.concat_ws("/", "a", "b"), F.upper(F.concat_ws("_", "a", "b")), F.concat(F.initcap("a"), F.initcap("b")),
    )
    return pair.select(F.explode(spelt).alias("text"), F.lit(False).alias("is_random"))


def random_strings(spark: SparkSession, per_kind: int = RANDOM_STRINGS) -> DataFrame:
    """Labelled samples made by rule: digests written in base 64 (both alphabets), lower and upper base 36 and hex."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    kinds = F.array(base64, F.translate(base64, "+/", "-_"), F.lower(base64), F.upper(base64), digest)
    return spark.range(per_kind).select(F.explode(kinds).alias("text"), F.lit(True).alias("is_random"))


def corpus_samples(
    docs: DataFrame, id_col="doc_id", text_col="text", words: int = WORD_DOCUMENTS, spans: int = SPAN_DOCUMENTS
) -> DataFrame:
    """Labelled samples of the corpus: what the base patterns find is random, words and names elsewhere are ordinary.

    Both come from documents chosen by hash, about ``spans`` of them for the first and ``words`` for the second.
    """
    count = max(1, docs.count())
    order = F.shiftrightunsigned(F.xxhash64("id", "text"), 2)
    share = lambda most: order <= min(1 << 62, (1 << 62) * most // count)
    plain = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    value = lambda s: F.when(s["kind"] == "assign", F.regexp_extract(s["hit"], ASSIGN, 2)).otherwise(s["hit"])
    found = plain.where(share(spans)).select(F.explode(F.transform(base_spans(F.col("text")), value)).alias("text"))
    # what a base pattern matches is cut out before words are taken
    rest = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), f"{ACCESS}|{_LONG_HEX}", " ")
    each = F.explode(F.regexp_extract_all(rest, F.lit("(?<![A-Za-z0-9+/_=-])[A-Za-z]+(?:[_-][A-Za-z]+)*(?![A-Za-z0-9+/_=-])"), F.lit(0)))
    ordinary = plain.where(share(words)).select(each.alias("text")).where("length(text) between 6 and 64")
    return found.select("text", F.lit(True).alias("is_random")).unionByName(ordinary.select("text", F.lit(False).alias("is_random")))


def _codes(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def train_markov(samples: DataFrame) -> MarkovRatio:
    """Counts transitions of labelled samples (text, is_random); add-one smoothing; null labels and texts are left out."""
    size = len(ALPHABET)
    pairs = F.explode(F.zip_with("codes", F.slice("codes", 2, F.size("codes")), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    counted = (
        samples.where("text is not null and text <> '' and is_random is not null")
        .select("is_random", _codes(F.col("text")).alias("codes"))
        .select("is_random", pairs.alias("p"))
        .where("p.a >= 0 and p.b >= 0")
        .groupBy("is_random", "p.a", "p.b")
        .count()
        .collect()  # 2 x alphabet x alphabet rows at most
    )
    counts = {True: [1] * size * size, False: [1] * size * size}
    for r in counted:
        counts[r["is_random"]][r["a"] * size + r["b"]] += r["count"]
    logs = {}
    for label, c in counts.items():
        # each label's transitions weigh as one, however many samples it has
        rows = [math.log(sum(c[i * size : (i + 1) * size])) for i in range(size)]
        logs[label] = [math.log(n) - rows[i // size] for i, n in enumerate(c)]
    return MarkovRatio(tuple(a - b for a, b in zip(logs[True], logs[False])))


def fit_thresholds(model: MarkovRatio, samples: DataFrame, precision: float = PRECISION) -> MarkovRatio:
    """``model`` with the thresholds that find the most random samples at the wanted precision, and with their figures.

    Of thresholds that find as many, the highest are taken.

    Only samples that are judged as tokens count. Without such samples of both labels the model stays as it is.
    """
    tokens = samples.where(F.col("is_random").isNotNull() & F.col("text").rlike(f"^{TOKEN}$")).select(
        "is_random", model.score(F.col("text")).alias("s"), (F.char_length("text") - 1).alias("n")
    )
    mean, total = F.floor(F.col("s") / F.col("n") / MEAN_STEP).cast("int"), F.floor(F.col("s") / SUM_STEP).cast("int")
    capped = lambda c, most: F.greatest(F.lit(-1), F.least(c, F.lit(most)))
    cells = tokens.groupBy("is_random", capped(mean, 100).alias("mean"), capped(total, 200).alias("sum")).count().collect()  # one row per cell
    all_random = sum(r["count"] for r in cells if r["is_random"])
    if not all_random or all_random == sum(r["count"] for r in cells):
        return model
    best = None
    for m in range(math.ceil(MEAN_LEAST / MEAN_STEP), 101):
        inside = [r for r in cells if r["mean"] >= m]
        for t in range(math.ceil(SUM_LEAST / SUM_STEP), 65, 2):
            hits = sum(r["count"] for r in inside if r["is_random"] and r["sum"] >= t)
            wrong = sum(r["count"] for r in inside if not r["is_random"] and r["sum"] >= t)
            if hits and hits >= precision * (hits + wrong) and (best is None or hits >= best[0]):
                best = hits, m * MEAN_STEP, t * SUM_STEP, hits / (hits + wrong)
    if best is None:
        return model
    return replace(model, least_mean=best[1], least_sum=best[2], precision=best[3], recall=best[0] / all_random)


def default_model(docs: DataFrame, id_col="doc_id", text_col="text") -> MarkovRatio:
    """Trained on the samples of the corpus and those made by rule; thresholds from the held-out ones among them."""
    spark = docs.sparkSession
    samples = ordinary_identifiers(spark).unionByName(random_strings(spark)).unionByName(corpus_samples(docs, id_col, text_col))
    samples = settle(samples.where("text <> ''").distinct())  # used twice; every string counts once
    back = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0
    return fit_thresholds(train_markov(samples.where(~back)), samples.where(back))


_GATE = ASSIGN.replace("=-]+)", "=-]{%d})" % ASSIGN_LEAST)
#: A run that is too short holds no run that is long enough, so the least length may stand in the pattern.
_LONG_HEX = HEX.replace("+", "{%d,}" % HEX_LEAST)


def base_spans(text: Column) -> Column:
    """Array of (start, rank, end, kind, hit) of the fixed patterns, kind by kind."""
    none = F.array().cast(f"array<{_SPAN}>")
    value = lambda hit: F.regexp_extract(hit, ASSIGN, 2)
    assign = F.when(text.rlike(_GATE), _spans(text, "assign", 0, ASSIGN, lambda h: F.char_length(value(h)) >= ASSIGN_LEAST)).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), _spans(text, "access", 1, ACCESS, lambda h: F.char_length(h) >= ACCESS_LEAST)).otherwise(none)
    hexes = F.when(text.rlike(_LONG_HEX), _spans(text, "hex", 2, _LONG_HEX, lambda h: F.lit(True))).otherwise(none)
    return F.concat(assign, access, hexes)


def secret_spans(text: Column, model: MarkovRatio) -> Column:
    """Array of (start, rank, end, kind, hit): base spans and, apart from those, tokens that the model finds random.

    Tokens have TOKEN_LEAST characters at least, plain words WORD_LEAST. Where one that is not random as a whole holds the marks of paths or
    assignments, its parts are judged too. Sorted by start, then in the order assign, access, hex, markov. Places are code
    points, the end exclusive.
    """
    none = F.array().cast(f"array<{_SPAN}>")

    def random(hit: Column) -> Column:
        score = model.score(hit)
        return _let(score, lambda s: (s >= model.least_sum) & (s >= model.least_mean * (F.char_length(hit) - 1)))

    tokens = _spans(text, "markov", 3, TOKEN, random)
    marked = [F.contains(text, F.lit(m)) for m in PART_MARKS]
    parts = F.when(marked[0] | marked[1], _spans(text, "markov", 3, PART, random)).otherwise(none)
    apart = lambda new, known: F.filter(new, lambda t: ~F.exists(known, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    whole = _let(base_spans(text), lambda known: F.concat(known, apart(tokens, known)))
    return _let(whole, lambda known: F.sort_array(F.concat(known, apart(parts, known))))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, model: MarkovRatio | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """Secrets of every row: ``doc_id, found`` (the spans) plus counts and digests of the base spans.

    A null or empty text has no spans. Repeated rows are scanned one by one. An empty table gives no rows. Without a
    model, one is trained on the default samples. Only the named columns are read, so others may have any name.
    """
    model = model or default_model(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("doc_id"), secret_spans(text, model).alias("found"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["rank"] < 3)
    return found.select(
        "doc_id", "found", count("assign"), count("access"), count("hex"), count("markov"),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"),
    )


def redact(text: Column, spans: Column, mark: Sequence[str] = ("<", "-redacted>")) -> Column:
    """``text`` with every span replaced by its kind between ``mark``; overlapping spans go as one, under the first kind."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark[0]), s["kind"], F.lit(mark[1]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.array_append(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
