"""Secret scan: known shapes, and a battery of randomness tests. DataFrame functions only.

Known shapes are assignments to a secret-like name, access keys and long lower-case hex.
Any other run of 20 or more key characters is a candidate. Its encoding is inferred (digits,
hex, base32, base64), its characters become ranks in that alphabet, and three tests ask
whether it can be random: chi-squared uniformity over the alphabet, runs above and below the
middle, and lag-1 serial correlation. Each has its own null distribution, by length and
alphabet: the moments of the statistic for a uniform random string (by Wilson and Hilferty's
cube root for chi-squared), the runs given how many characters are high, and the moments of
the correlation over all orders. Their p-values meet in the Cauchy combination, which
holds for tests that depend on each other.

False discoveries are controlled per length class by the Benjamini-Hochberg rule: the
candidates whose p-values it rejects are structured, not random, so that at most the stated
share of what is set aside was random after all. A gate follows for short strings, on which
no test has power: of what is left, a candidate's likelihood as text over its likelihood as
random, which under a fixed model of text is at most p with chance p (Markov's inequality),
has to pass the same rule within its class. Both cutoffs come from one histogram over all
documents with a fixed number of bins, so nothing unbounded is sorted or collected. Plain
words are neither tested nor reported.

Work per text is linear in its length, but for sorts and running sums (n log n): a running
sum adds the array to itself at distances 1, 2, 4, ... . The texts are scanned once; base
spans and tested candidates are stored and read again when the cutoffs are known.

Defined results: null text counts as empty. Repeated rows and ids are scanned row by row.
Only doc_id and text are read; other columns pass through `redact` whatever their names.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stored import store

# Fixed values of the known shapes.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WORD = r"^[A-Za-z][a-z]+$"
KINDS = ("assign", "access", "hex", "random")
MARK = "[SECRET]"

FALSE_DISCOVERIES = 0.01
LENGTH_CLASSES = (20, 24, 32, 48, 80, 160)
BINS = 256
_BIN_WIDTH = 0.25  # of -ln(p-value)
_LEAST_P = 1e-28

# The model of text: chances of the kind of a character (lower, upper, digit, mark) after each
# kind; a text begins as after a mark. Marks, and digits, are equally likely among themselves.
_AFTER = (
    (0.85, 0.04, 0.03, 0.08),
    (0.66, 0.25, 0.04, 0.05),
    (0.10, 0.05, 0.65, 0.20),
    (0.60, 0.12, 0.15, 0.13),
)
# Of 1,000 letters, a to z, over European languages.
_LETTERS = (80, 16, 32, 38, 135, 18, 19, 35, 72, 4, 8, 44, 27, 72, 62, 24, 6, 64, 67, 72, 38, 12, 12, 4, 12, 6)

_ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def _let(body: Callable[[Column], Column], **values: Column) -> Column:
    """`body` of a struct whose fields are computed once, however often it reads them."""
    bound = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.element_at(F.transform(bound, body), 1)


def _running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Running sum, maximum or the like of an array, in log2(size) passes over it."""
    rounds = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")
    shifts = F.transform(F.when(rounds > 0, F.sequence(F.lit(0), rounds - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.pow(F.lit(2.0), k).cast("int"))

    def add(held: Column, shift: Column) -> Column:
        return F.transform(held, lambda v, i: F.when(i >= shift, merge(v, F.get(held, i - shift))).otherwise(v))

    return F.aggregate(shifts, values, add)


def _matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """array<struct<start, end, value>> of all matches, left to right; `value` is the match
    or its group. The pieces between the matches give the offsets."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def spans(row: Column) -> Column:
        return F.transform(
            row["values"],
            lambda v, i: F.struct((F.get(row["ends"], i) - F.get(row["sizes"], i)).alias("start"), F.get(row["ends"], i).alias("end"), v.alias("value")),
        )

    def ends(row: Column) -> Column:
        steps = F.zip_with(row["gaps"], row["sizes"], lambda gap, size: gap + size)
        return _let(spans, values=row["values"], sizes=row["sizes"], ends=_running(steps, lambda x, y: x + y))

    def measured(row: Column) -> Column:
        gaps = F.transform(F.slice(row["pieces"], F.lit(1), F.size(row["found"])), F.char_length)
        return _let(ends, gaps=gaps, sizes=F.transform(row["found"], F.char_length), values=row["values"])

    return F.when(text.rlike(pattern), _let(measured, found=found, values=values, pieces=F.split(text, pattern, -1))).otherwise(empty)


def _tagged(spans: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))
    )


def _encoding(value: Column) -> Column:
    return (
        F.when(value.rlike("^[0-9]+$"), F.lit("decimal"))
        .when(value.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit("hex"))
        .when(value.rlike("^[A-Z2-7]+=*$"), F.lit("base32"))
        .otherwise(F.lit("base64"))
    )


def _shaped(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of the value's encoding, its alphabet, and its characters in base64 unpadded."""

    def alphabet(row: Column) -> Column:
        letters = F.lit(None).cast("string")
        for name, own in _ALPHABETS.items():
            letters = F.when(row["kind"] == name, F.lit(own)).otherwise(letters)
        return _let(body, kind=row["kind"], letters=letters, plain=F.translate(F.rtrim(value, F.lit("=")), "-_", "+/"))

    return _let(alphabet, kind=_encoding(value))


def _evidence(row: Column) -> Column:
    """-ln of the p-value as text: ln of the likelihood as random, by one of the encodings, over text."""
    letters = [math.log(n / sum(_LETTERS)) for n in _LETTERS]
    marks = [math.log(1 / 3)] * 2
    chances = F.array(*map(F.lit, marks[:1] + letters + letters + [math.log(0.1)] * 10 + marks))
    after = F.array(*(F.lit(math.log(p)) for chances_ in _AFTER for p in chances_))
    ranks = F.transform(F.split(row["plain"], ""), lambda c: F.instr(F.lit(_ALPHABETS["base64"]), c))  # 0 is an inner =

    def kind(rank: Column) -> Column:
        return F.when((rank == 0) | (rank > 62), 3).when(rank > 52, 2).when(rank > 26, 0).otherwise(1)

    def step(state: Column, rank: Column) -> Column:
        here = kind(rank)
        more = F.get(chances, rank) + F.get(after, state["last"] * 4 + here)
        return F.struct((state["sum"] + more).alias("sum"), here.alias("last"))

    text = F.aggregate(ranks, F.struct(F.lit(0.0).alias("sum"), F.lit(3).alias("last")), step, lambda s: s["sum"])
    return -F.length(row["plain"]) * F.log(F.length(row["letters"])) - F.log(F.lit(float(len(_ALPHABETS)))) - text


def _tail(z: Column) -> Column:
    """Chance of a standard normal above z: density times a polynomial (Abramowitz, Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z >= 0, upper).otherwise(1 - upper)


def combined(*p_values: Column) -> Column:
    """Cauchy combination; p-values next to 0 and 1 are cut so that each keeps a finite weight."""

    def weight(p: Column) -> Column:
        p = F.least(F.greatest(p, F.lit(_LEAST_P)), F.lit(0.99))
        return F.when(p < 1e-8, 1 / (p * math.pi)).otherwise(F.tan((0.5 - p) * math.pi))

    mean = sum((weight(p) for p in p_values[1:]), weight(p_values[0])) / len(p_values)
    return _let(lambda r: F.when(r["t"] > 1e8, 1 / (r["t"] * math.pi)).otherwise(0.5 - F.atan(r["t"]) / math.pi), t=mean)


def _battery(row: Column) -> Column:
    """Combined p-value, as random, of ranks `x` (1 to k, 0 for a stranger) in an alphabet of k."""
    zero = F.lit(0).cast("long")

    def step(state: Column, x: Column) -> Column:
        high = x > row["k"] / 2
        return F.struct(
            x.alias("last"),
            high.alias("side"),
            (state["sum"] + x).alias("sum"),
            (state["squares"] + x * x).alias("squares"),
            (state["product"] + x * state["last"]).alias("product"),
            (state["high"] + high.cast("int")).alias("high"),
            (state["changes"] + (high != state["side"]).cast("int")).alias("changes"),
        )

    first = F.get(row["x"], F.lit(0))
    names = ("sum", "squares", "product", "high", "changes")
    start = F.struct(zero.alias("last"), (first > row["k"] / 2).alias("side"), *[zero.alias(n) for n in names])

    def repeat(state: Column, x: Column) -> Column:
        run = F.when(x == state["last"], state["run"] + 1).otherwise(1).cast("long")
        return F.struct(x.alias("last"), run.alias("run"), (state["sum"] + 2 * run - 1).alias("sum"))

    # Sum of the squared counts of each character, from the sorted ranks: 1 + 3 + 5 + ... = c^2.
    counts = F.aggregate(F.array_sort(row["x"]), F.struct(F.lit(-1).cast("long").alias("last"), zero.alias("run"), zero.alias("sum")), repeat, lambda s: s["sum"])
    return _let(_p_value, sums=F.aggregate(row["x"], start, step), counts=counts, first=first, n=F.size(row["x"]).cast("double"), k=row["k"].cast("double"))


def _p_value(row: Column) -> Column:
    n, k, sums = row["n"], row["k"], row["sums"]
    # Chi-squared of a uniform multinomial: mean k-1, variance 2(k-1)(n-1)/n; a gamma with these.
    chi = k / n * row["counts"] - n
    shape = 9 * (k - 1) * n / (2 * (n - 1))
    uniform = (F.pow(F.greatest(chi, F.lit(0.0)) / (k - 1), F.lit(1 / 3)) - 1 + 1 / shape) * F.sqrt(shape)
    # Runs given the number of high characters; with none or all high, as far off as can be.
    expected = 2 * sums["high"] * (n - sums["high"]) / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    apart = F.greatest(F.abs(sums["changes"] + 1 - expected) - 0.5, F.lit(0.0))
    runs = F.when(spread > 0, apart / F.sqrt(spread)).otherwise(F.sqrt(n))
    # Lag-1 correlation over all orders of the characters: mean -1/n, variance (n-2)^2 / (n^2 (n-1)).
    mean = sums["sum"] / n
    scale = sums["squares"] - n * mean * mean
    product = sums["product"] - mean * (2 * sums["sum"] - row["first"] - sums["last"]) + (n - 1) * mean * mean
    serial = F.when(scale > 0, F.abs(product / scale + 1 / n) * n * F.sqrt(n - 1) / (n - 2)).otherwise(F.sqrt(n))
    return F.when(n > 3, combined(_tail(uniform), 2 * _tail(runs), 2 * _tail(serial))).otherwise(F.lit(_LEAST_P))


def _tested(value: Column) -> Column:
    """struct<random, text>: bins of -ln p as random (by the battery) and as text."""

    def bin_(minus_log: Column) -> Column:
        return F.least(F.greatest(F.floor(minus_log / _BIN_WIDTH), F.lit(0)), F.lit(BINS - 1)).cast("int")

    def shaped(row: Column) -> Column:
        plain = F.when(row["kind"] == "hex", F.lower(row["plain"])).otherwise(row["plain"])
        ranks = F.transform(F.split(plain, ""), lambda c: F.instr(row["letters"], c).cast("long"))
        p = _let(_battery, x=ranks, k=F.length(row["letters"]))
        return F.struct(bin_(-F.log(F.greatest(p, F.lit(_LEAST_P)))).alias("random"), bin_(_evidence(row)).alias("text"))

    return _shaped(value, shaped)


def _length_class(value: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(LENGTH_CLASSES):
        out = F.when(F.length(value) >= least, F.lit(i)).otherwise(out)
    return out


def _base(text: Column) -> Column:
    assign = F.filter(_matches(text, ASSIGN, 2), lambda s: F.length(s["value"]) >= ASSIGN_LEAST)
    return F.array_sort(
        F.concat(_tagged(assign, "assign"), _tagged(_matches(text, ACCESS), "access"), _tagged(_matches(text, HEX), "hex"))
    )


def _apart(spans: Column, base: Column) -> Column:
    """The spans that touch no base span; both are sorted together, so each is met once."""
    item = "array<struct<start:int,end:int,value:string>>"
    marked = F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.lit(None).cast("string").alias("value")))

    def checked(row: Column) -> Column:
        kept = F.transform(
            row["all"],
            lambda s, i: F.when(s["value"].isNotNull() & (F.get(row["before"], i) <= s["start"]) & (F.get(row["after"], F.size(row["all"]) - 1 - i) >= s["end"]), s),
        )
        return F.filter(kept, lambda s: s.isNotNull()).cast(item)

    def merged(row: Column) -> Column:
        ends = F.transform(row["all"], lambda s: F.when(s["value"].isNull(), s["end"]).otherwise(0))
        starts = F.transform(F.reverse(row["all"]), lambda s: F.when(s["value"].isNull(), s["start"]).otherwise(2**31 - 1))
        # The largest end of a base span so far, and (from behind) the smallest start to come.
        return _let(checked, all=row["all"], before=_running(ends, F.greatest), after=_running(starts, F.least))

    together = _let(merged, all=F.array_sort(F.concat(marked, spans)))
    return F.when((F.size(base) == 0) | (F.size(spans) == 0), spans).otherwise(together)


def _candidates(text: Column, base: Column) -> Column:
    """Candidates that touch no base span and are no plain word, with length class and bins."""

    def judged(c: Column) -> Column:
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), _length_class(c["value"]).alias("cls"), _tested(c["value"]).alias("bin"))

    free = F.filter(_matches(text, CANDIDATE), lambda c: ~c["value"].rlike(WORD))
    return F.transform(_let(lambda row: _apart(row["free"], base), free=free), judged)


def _scanned(docs: DataFrame) -> DataFrame:
    """Every row as `_row`, with its base spans and tested candidates; stored."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), text.alias("_text"))
    rows = rows.withColumn("_base", _base(F.col("_text")))
    return rows.withColumn("_candidates", _candidates(F.col("_text"), F.col("_base")))


def _rejected(counts: list[int], share: float) -> int:
    """Benjamini-Hochberg on counts per bin of -ln p: the first bin that is rejected, or BINS."""
    found, out, total = 0, BINS, sum(counts)
    for b in range(BINS - 1, 0, -1):
        found += counts[b]
        if counts[b] and math.exp(-b * _BIN_WIDTH) <= share * found / total:
            out = b
    return out


def cutoffs(scanned: DataFrame, false_discoveries: float = FALSE_DISCOVERIES) -> dict[int, tuple[int, int]]:
    """Per length class, from a histogram over all candidates: the first bin of the battery that
    is structured, and the first bin of the gate that is not text."""
    counts = (
        scanned.select(F.explode("_candidates").alias("c"))
        .groupBy("c.cls", "c.bin.random", "c.bin.text")
        .agg(F.count("*").alias("n"))
        .collect()  # at most length classes x bins x bins rows
    )
    out = {}
    for c in range(len(LENGTH_CLASSES)):
        own = [r for r in counts if r["cls"] == c]
        battery, gate = [0] * BINS, [0] * BINS
        for r in own:
            battery[r["random"]] += r["n"]
        structured = _rejected(battery, false_discoveries)
        # The gate counts every candidate as a test; a structured one has p-value one.
        for r in own:
            gate[r["text"] if r["random"] < structured else 0] += r["n"]
        out[c] = structured, _rejected(gate, false_discoveries)
    return out


def _all_spans(limit: dict[int, tuple[int, int]]) -> Column:
    """Base spans and the reported candidates, in order."""
    structured, text = (F.array(*[F.lit(limit[c][i]) for c in range(len(LENGTH_CLASSES))]) for i in (0, 1))
    random = F.filter(F.col("_candidates"), lambda c: (c["bin"]["random"] < F.get(structured, c["cls"])) & (c["bin"]["text"] >= F.get(text, c["cls"])))
    return F.array_sort(F.concat(F.col("_base"), _tagged(random, "random")))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, false_discoveries: float = FALSE_DISCOVERIES) -> DataFrame:
    """doc_id, counts of base spans, digest of the base spans, and all spans as text and array."""
    scanned = _scanned(docs.select("doc_id", "text"))
    kept = store(scanned.select(F.col("_row.doc_id").cast("long").alias("doc_id"), "_base", "_candidates"), "spans")
    rows = kept.withColumn("_all", _all_spans(cutoffs(kept, false_discoveries)))

    def count(kind: str) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")

    return rows.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(_written(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("_all")).alias("spans"),
        F.transform("_all", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("found"),
    )


def redact(docs: DataFrame, false_discoveries: float = FALSE_DISCOVERIES) -> DataFrame:
    """The documents with every span replaced by MARK; overlapping spans by one. Rows without
    a secret, null texts included, stay as they are. A column n_chars follows the text."""
    kept = store(_scanned(docs).drop("_text"), "spans")
    rows = kept.withColumn("_all", _all_spans(cutoffs(kept, false_discoveries)))

    def pieces(row: Column) -> Column:
        """Up to each span that begins past all earlier ones: the text between, and a mark."""

        def piece(span: Column, i: Column) -> Column:
            at = F.when(i > 0, F.get(row["ends"], i - 1)).otherwise(0)
            between = F.array_join(F.slice(row["chars"], at + 1, F.greatest(span["start"] - at, F.lit(0))), "")
            return F.when(span["start"] >= at, F.concat(between, F.lit(MARK))).otherwise("")

        last = F.element_at(row["ends"], -1)
        tail = F.array_join(F.slice(row["chars"], last + 1, F.size(row["chars"])), "")
        return F.concat(F.array_join(F.transform(row["all"], piece), ""), tail)

    ends = _running(F.transform("_all", lambda s: s["end"]), F.greatest)
    clean = _let(pieces, all=F.col("_all"), ends=ends, chars=F.split(F.col("_row")["text"].cast("string"), ""))
    rows = rows.withColumn("_clean", F.when(F.size("_all") > 0, clean))
    columns = []
    for field in docs.schema.fields:
        own = F.col("_row")[field.name]
        if field.name == "text":
            own = F.coalesce(F.col("_clean"), own).cast(field.dataType)
        elif field.name == "n_chars":
            own = F.when(F.col("_clean").isNotNull(), F.char_length("_clean")).otherwise(own).cast(field.dataType)
        if not field.nullable and isinstance(field.dataType, (T.StringType, T.NumericType, T.BooleanType)):
            own = F.coalesce(own, F.lit("0").cast(field.dataType))  # stored columns may be null; this one is not
        columns.append(own.alias(field.name))
    return rows.select(*columns)
