"""Secret scans: known forms of secrets, and tokens that pass a battery of randomness tests.

Base spans are matches of fixed patterns. The method looks at every other run of 20 or
more characters of ``[A-Za-z0-9+/_-]``; ``=`` belongs to it only as padding at its end, so
the name and the value of ``name=value`` are runs of their own:

1. The encoding is inferred from the characters: hex (either case), base 32, base 36
   (lower case and digits) or base 64. Runs of letters only and of digits only have
   none: they are words and numbers.
2. The battery: under the hypothesis that symbols are drawn uniformly from the encoding's
   alphabet, three tests give a probability each: chi-squared over the alphabet (upper
   tail, Wilson-Hilferty), runs of symbols of the upper and lower half, and the correlation of
   neighbouring symbols (both two-sided). Fisher's method combines them; a run below ``gate`` is
   not random and is passed over, however unlike words it may be.
3. False discoveries are plain identifiers, so their control tests the hypothesis that a run is one.
   ``identifier_model`` is a chain over characters: letters follow letters as in words,
   and cases, digits and separators change as in names. If a run has the likelihood W in it, and U
   under uniform draws from its alphabet, then a plain identifier has U / W >= t with a
   probability of 1 / t at most (Markov's inequality), so W / U is a p-value at any length.
4. Runs are split by encoding and length octave, as a short run proves less than a long
   one. In each part the Benjamini-Hochberg procedure at ``rate`` decides which runs are
   no identifiers; those that also pass the battery become spans if their length is worth
   ``min_bits``. The procedure runs on counts by bins of the logarithm of p, rounded up, so it
   is exact to a bin and its table has a fixed size.

Positions are code points, the end exclusive. Rules: a null text is empty; a run that
overlaps a base span adds nothing; rows with equal ids or texts are scanned each on its
own; texts are scanned whole, however long; an empty table gives an empty result; other
columns play no part. Column expressions only; nothing is shuffled but the
table of bins.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.session import written

# fixed values: the forms, and a cheaper test for texts that can hold them
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {
    "assign": (r"(?i)password|passwd|secret|token|api_?key", ASSIGN, 2, 6),
    "access": (r"AKIA[A-Z0-9]{16}", r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24}", r"[0-9a-f]+", 0, 24),
}
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:=++(?![A-Za-z0-9+/_-]))?"
KINDS = [*BASE, "random"]
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": string.ascii_uppercase + "234567",
    "base36": string.digits + string.ascii_lowercase,
    "base64": string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/",
}

RATE = 0.01
GATE = 1e-4
MIN_BITS = 80
_BIN = 0.02  # of log10 p
_BLOCK = 256

# fixed values: common words, which give the chain its pairs of letters
WORDS = (
    "the of and to in is you that it he was for on are with as his they be at one have this from or had by hot word but what some we can out other were all"
    " there when up use your how said an each she which do their time if will way about many then them write would like so these her long make thing see him"
    " two has look more day could go come did number sound no most people my over know water than call first who may down side been now find any new work part"
    " take get place made live where after back little only round man year came show every good me give our under name very through just form sentence great"
    " think say help low line differ turn cause much mean before move right boy old too same tell does set three want air well also play small end put home"
    " read hand port large spell add even land here must big high such follow act why ask men change went light kind off need house picture try us again"
    " user service policy review spring winter summer movie system value index table query function string object number final version service access config"
    " request response client server update delete create session holiday variable manager buffer thread parser review market garden yellow orange"
).split()
SEPARATORS = {"_": 0.45, "-": 0.35, "/": 0.15, "+": 0.05}
# how lower case, upper case, digits and separators follow each other in names; the first row is the start
CLASSES = {
    "": (0.50, 0.35, 0.10, 0.05), "lower": (0.80, 0.06, 0.05, 0.09), "upper": (0.35, 0.50, 0.05, 0.10),
    "digit": (0.15, 0.08, 0.55, 0.22), "separator": (0.50, 0.25, 0.20, 0.05),
}
SYMBOLS = string.ascii_lowercase + string.ascii_uppercase + string.digits + "".join(SEPARATORS)
_EVEN = 0.25  # of any letter after any other


def _with_starts(df: DataFrame, name: str, text: str, quick: str, pattern: str, group: int, least: int) -> DataFrame:
    """Add an array of (start, end, token) of the matches, those with a long enough group.

    Gaps and matches alternate, so starts are running sums of lengths; these run in two
    levels, over blocks and within a block, to stay cheap for any number of matches.
    """
    may = F.col(text).rlike(quick)
    none = F.array().cast("array<string>")
    df = df.withColumns({
        "m_token": F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
        "m_group": F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none),
        "m_gap": F.when(may, F.split(text, pattern)).otherwise(none),
    })
    df = df.withColumn("m_step", F.zip_with("m_gap", "m_token", lambda g, t: F.char_length(g) + F.coalesce(F.char_length(t), F.lit(0))))
    add = lambda total, x: total + x
    count = F.greatest(F.ceil(F.size("m_step") / _BLOCK).cast("int"), F.lit(1))
    df = df.withColumn("m_block", F.transform(
        F.sequence(F.lit(0), count - 1), lambda b: F.aggregate(F.slice("m_step", b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), add)
    )).withColumn("m_head", F.transform("m_block", lambda _, b: F.aggregate(F.slice("m_block", F.lit(1), b), F.lit(0), add)))

    def span(token: Column, i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        # m_head is used twice so that the planner keeps it as a column of its own
        head = F.coalesce(F.get("m_head", block), F.element_at("m_head", -1))
        start = head + F.aggregate(F.slice("m_step", block * _BLOCK + 1, i % _BLOCK), F.lit(0), add) + F.char_length(F.get("m_gap", i))
        return F.struct(
            start.alias("start"), (start + F.char_length(token)).alias("end"), token.alias("token"),
            F.char_length(F.get("m_group", i)).alias("size"),
        )

    spans = F.filter(F.transform("m_token", span), lambda s: s["size"] >= least)
    return df.withColumn(name, spans).drop("m_token", "m_group", "m_gap", "m_step", "m_block", "m_head")


def _normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by a rational approximation (error below 1e-7)."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _p(tail: Column) -> Column:
    return F.least(F.greatest(tail, F.lit(1e-30)), F.lit(1.0))


def _class(symbol: str) -> str:
    return "lower" if symbol.islower() else "upper" if symbol.isupper() else "digit" if symbol.isdigit() else "separator"


def identifier_model() -> list[float]:
    """Natural logarithms of the probability of each symbol after each other; the first row is the start."""
    pairs = {a: {b: 0 for b in string.ascii_lowercase} for a in " " + string.ascii_lowercase}
    for word in WORDS:
        for a, b in zip(f" {word}", word):
            pairs[a][b] += 1

    def letter(a: str, b: str) -> float:
        total = sum(pairs[a].values())
        return _EVEN / 26 + (1 - _EVEN) * (pairs[a][b] / total if total else 1 / 26)

    def probability(before: str, symbol: str) -> float:
        kind = _class(symbol)
        share = CLASSES[_class(before) if before else ""]["lower upper digit separator".split().index(kind)]
        if kind == "digit":
            return share / 10
        if kind == "separator":
            return share * SEPARATORS[symbol]
        # a capital after a small letter begins a word
        goes_on = before.isalpha() and not (before.islower() and kind == "upper")
        return share * letter(before.lower() if goes_on else " ", symbol.lower())

    return [math.log(probability(before, symbol)) for before in ("", *SYMBOLS) for symbol in SYMBOLS]


def word_like(token: Column, kind: str) -> Column:
    """log10 of the p-value of the hypothesis that the token is a plain identifier."""
    body = F.rtrim(token, F.lit("="))
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in identifier_model())), ",").cast("array<double>")
    codes = F.transform(F.split(body, ""), lambda c: F.instr(F.lit(SYMBOLS), c))
    steps = F.zip_with(F.concat(F.array(F.lit(0)), codes), codes, lambda a, b: F.when(b.isNotNull(), a * len(SYMBOLS) + b - 1))
    in_words = F.aggregate(F.filter(steps, lambda i: i.isNotNull()), F.lit(0.0), lambda s, i: s + F.get(table, i.cast("int")))
    return F.least((in_words + F.char_length(body) * math.log(len(ALPHABETS[kind]))) / math.log(10), F.lit(0.0))


def encoding(token: Column) -> Column:
    body = F.rtrim(token, F.lit("="))
    return (
        F.when(~body.rlike("[0-9]") | ~body.rlike("[A-Za-z]"), None)
        .when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(body.rlike("^[A-Z2-7]+$"), "base32")
        .when(body.rlike("^[0-9a-z]+$"), "base36")
        .when(body.rlike("^[A-Za-z0-9+/_-]+$"), "base64")
    )


def battery(token: Column, kind: str) -> Column:
    """Probability that a uniform draw from the alphabet looks as odd as the token."""
    alphabet = ALPHABETS[kind]
    k = len(alphabet)
    body = F.rtrim(token, F.lit("="))
    if kind == "hex":
        body = F.lower(body)
    if kind == "base64":
        body = F.translate(body, "-_", "+/")
    n = F.char_length(body).cast("double")
    letters = F.split(F.lit(alphabet), "")
    squares = F.aggregate(letters, F.lit(0.0), lambda s, a: s + F.pow(n - F.char_length(F.replace(body, a, F.lit(""))), 2.0))
    chi = k / n * squares - n
    spread = 2 / (9 * (k - 1))
    z_chi = (F.pow(chi / (k - 1), 1 / 3) - (1 - spread)) / spread**0.5

    halves = F.translate(body, alphabet, "0" * (k // 2) + "1" * (k - k // 2))
    high = F.char_length(F.replace(halves, F.lit("0"), F.lit(""))).cast("double")
    pairs = lambda p: (n - F.char_length(F.replace(halves, F.lit(p), F.lit("")))) / 2
    runs = 1 + pairs("01") + pairs("10")
    both = 2 * high * (n - high)
    variance = both * (both - n) / (n * n * (n - 1))
    p_runs = F.when(variance > 0, 2 * _normal_tail(F.abs(runs - both / n - 1) / F.sqrt(variance))).otherwise(0.0)

    mean, sigma2 = (k - 1) / 2, (k * k - 1) / 12
    values = F.transform(F.split(body, ""), lambda c: F.instr(F.lit(alphabet), c) - 1 - mean)
    follows = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    product = F.aggregate(F.zip_with(values, follows, lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    p_serial = 2 * _normal_tail(F.abs(product) / (sigma2 * F.sqrt(n - 1)))

    x = -(F.log(_p(_normal_tail(z_chi))) + F.log(_p(p_runs)) + F.log(_p(p_serial)))
    return F.exp(-x) * (1 + x + x * x / 2)


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base spans by kind, and the other runs with encoding, length octave, bin of p and the battery's p."""
    df = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    for kind, (quick, pattern, group, least) in BASE.items():
        df = _with_starts(df, kind, "text", quick, pattern, group, least)
    df = _with_starts(df, "runs", "text", "[A-Za-z0-9+/_-]{20}", RUN, 0, 20)
    base = F.concat(*BASE)
    apart = lambda r: ~F.exists(base, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
    kinds = F.transform("runs", lambda r: F.struct(r["start"], r["end"], r["token"], encoding(r["token"]).alias("encoding")))
    df = df.withColumn("runs", F.filter(kinds, lambda r: r["encoding"].isNotNull() & apart(r)))

    def tested(r: Column) -> Column:
        p, log_p = F.lit(None).cast("double"), F.lit(None).cast("double")
        bits = F.lit(0.0)
        for kind, alphabet in ALPHABETS.items():
            p = F.when(r["encoding"] == kind, battery(r["token"], kind)).otherwise(p)
            log_p = F.when(r["encoding"] == kind, word_like(r["token"], kind)).otherwise(log_p)
            bits = F.when(r["encoding"] == kind, F.log2(F.lit(len(alphabet)))).otherwise(bits)
        size = F.char_length(F.rtrim(r["token"], F.lit("=")))
        return F.struct(
            r["start"].alias("start"), r["end"].alias("end"), r["encoding"].alias("encoding"), (size * bits).alias("bits"),
            F.floor(F.log2(size)).cast("int").alias("octave"), F.floor(F.greatest(log_p, F.lit(-30.0)) / _BIN).cast("int").alias("bin"), p.alias("uniform"),
        )

    places = {kind: F.transform(kind, lambda s: F.struct(s["start"], s["end"])) for kind in BASE}
    return df.select("doc_id", *[c.alias(kind) for kind, c in places.items()], F.transform("runs", tested).alias("runs"))


def cutoffs(found: DataFrame, rate: float) -> dict[tuple[str, int], int]:
    """For each encoding and length octave the highest bin of p at which a run is no plain identifier."""
    bins = found.select(F.explode("runs").alias("r")).groupBy("r.encoding", "r.octave", "r.bin").agg(F.count("*").alias("n"))
    part = Window.partitionBy("encoding", "octave")
    ranked = bins.select(
        "encoding", "octave", "bin", F.sum("n").over(part.orderBy("bin")).alias("rank"), F.sum("n").over(part).alias("all")
    )
    passed = F.pow(F.lit(10.0), (F.col("bin") + 1) * _BIN) <= rate * F.col("rank") / F.col("all")
    rows = ranked.filter(passed).groupBy("encoding", "octave").agg(F.max("bin").alias("bin")).collect()  # a few octaves
    return {(row["encoding"], row["octave"]): row["bin"] for row in rows}


def _limit(limits: dict[tuple[str, int], int], run: Column) -> Column:
    limit = F.lit(-(10**6))  # below every bin: nothing is found
    for (kind, octave), top in sorted(limits.items()):
        limit = F.when((run["encoding"] == kind) & (run["octave"] == octave), top).otherwise(limit)
    return limit


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 rate: float = RATE, min_bits: float = MIN_BITS, gate: float = GATE) -> DataFrame:
    """doc_id and, for each kind, its spans in the order of the text."""
    found = written(scanned(docs, doc_id, text), "secret-runs")
    limits = cutoffs(found, rate)
    random = F.filter("runs", lambda r: (r["bits"] >= min_bits) & (r["uniform"] >= gate) & (r["bin"] <= _limit(limits, r)))
    return found.select("doc_id", *BASE, F.transform(random, lambda r: F.struct(r["start"], r["end"])).alias("random"))


def _marked(rank: int, kind: str):
    return lambda s: F.struct(
        s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")
    )


def digest(spans: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    def joined(kinds: list[str]) -> Column:
        marked = F.concat(*[
            F.transform(kind, _marked(rank, kind)) for rank, kind in enumerate(kinds)
        ])
        return F.array_join(F.transform(F.array_sort(marked), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return spans.select(
        "doc_id", *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(joined([*BASE]), 256).alias("base_sha256"), joined(KINDS).alias("spans"),
    )
