"""Secrets in texts: known patterns, and strings that pass a battery of randomness tests.

Everything here is Spark SQL.  Long runs of key characters are candidates.  For each, the
smallest encoding that holds it is inferred (hex, base32, base36, base64), and three tests
ask whether it is as uneven as text: the chi-squared statistic of its alphabet, the runs of
its character classes and the serial correlation of its codes.  The null hypothesis of each
is "like text", so a small value means "random", and the longer a string, the more it can
show.  The three normal scores are added up, and a string that fails to lean towards
random in any one of them shows nothing.
False discoveries are held at a given rate within each stratum of encoding and length, from
counts per stratum over the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from terracell.llm.registry import query, read
from terracell.llm.store import columns

KEYWORD = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so asking for the length in the pattern drops just the failing matches.
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])"
KINDS = ("assign", "access", "hex", "random")
RATE = 0.01
BINS_PER_DECADE, TOP_BIN = 20, 600

#: Encodings from the smallest alphabet up: name, pattern, alphabet.
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdef"),
    ("base32", "^[A-Z2-7]+=*$", _LOWER + "234567"),
    ("base36", "^([0-9a-z]+|[0-9A-Z]+)$", _DIGITS + _LOWER),
    ("base64", "^.*$", _LOWER.upper() + _LOWER + _DIGITS + "+/-_"),
)
#: How uneven text is, against a random string: repeated characters, changes of class, correlation.
UNEVEN, CHANGES, CORRELATION = 1.8, 0.5, 0.5


def _found(text: str, pattern: str, kind: int, keep: str = "true") -> str:
    """Array of (start, kind, end, said) of the leftmost matches of a pattern, without overlap.

    The text between matches comes from ``split``, so places are sums of lengths.
    ``keep`` is a condition on ``x.m``, the match.
    """
    said = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return f"""
    CASE WHEN regexp_like({text}, '{said}') THEN
      filter(aggregate(
        filter(zip_with(split({text}, '{said}', -1), regexp_extract_all({text}, '{said}', 0),
                        (g, m) -> named_struct('g', g, 'm', m)), x -> x.m IS NOT NULL),
        named_struct('at', 0L, 'out', CAST(array() AS array<struct<start:bigint,kind:int,end:bigint,said:string>>)),
        (a, x) -> named_struct(
          'at', a.at + char_length(x.g) + char_length(x.m),
          'out', array_append(a.out, named_struct('start', a.at + char_length(x.g), 'kind', {kind},
                              'end', a.at + char_length(x.g) + char_length(x.m), 'said', x.m))),
        a -> a.out), x -> {keep})
    ELSE CAST(array() AS array<struct<start:bigint,kind:int,end:bigint,said:string>>) END"""


def _normal_tail(z: str) -> str:
    """P(Z > z) of a standard normal variable, to seven digits."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    upper = (
        f"(0.3989422804014327 * exp(-({z}) * ({z}) / 2) * {t} * (0.319381530 + {t} * (-0.356563782"
        f" + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    )
    return f"(CASE WHEN {z} >= 0 THEN {upper} ELSE 1 - {upper} END)"


def _case(value: int, of: str) -> str:
    return "CASE " + of + " " + " ".join(f"WHEN {i} THEN '{e[value]}'" for i, e in enumerate(ENCODINGS)) + " END"


def _tested(candidates: str) -> str:
    """Candidates with their stratum and the bin of their p value, as an array."""
    inferred = "CASE " + " ".join(f"WHEN regexp_like(x.said, '{e[1]}') THEN {i}" for i, e in enumerate(ENCODINGS)) + " END"
    # Letter case says nothing in the alphabets that have one case only.
    coded = f"""transform({candidates}, x -> named_struct('start', x.start, 'end', x.end, 'enc', {inferred},
        'said', rtrim('=', x.said)))"""
    codes = f"""transform({coded}, x -> named_struct('start', x.start, 'end', x.end, 'enc', x.enc,
        'n', CAST(char_length(x.said) AS double),
        'k', CAST(char_length({_case(2, 'x.enc')}) AS double),
        'codes', transform(split(x.said, ''), c -> CAST(instr({_case(2, 'x.enc')},
                           CASE WHEN x.enc = 3 THEN c ELSE lower(c) END) AS double)),
        'classes', split(translate(x.said, '{_LOWER}{_LOWER.upper()}{_DIGITS}+/-_',
                         '{"a" * 26}' || CASE WHEN x.enc = 3 THEN '{"A" * 26}' ELSE '{"a" * 26}' END || '{"0" * 10}....'), '')))"""
    sums = f"""transform({codes}, x -> named_struct('start', x.start, 'end', x.end, 'enc', x.enc, 'n', x.n, 'k', x.k,
        'chi2', x.k / x.n * aggregate(array_distinct(x.codes), 0D, (s, c) ->
                s + power(size(filter(x.codes, y -> y = c)), 2)) - x.n,
        'changes', CAST(size(filter(sequence(2, CAST(x.n AS int)), i -> x.classes[i - 1] != x.classes[i - 2])) AS double),
        'mean', aggregate(x.codes, 0D, (s, c) -> s + c) / x.n,
        'square', aggregate(x.codes, 0D, (s, c) -> s + c * c) / x.n,
        'lagged', aggregate(sequence(2, CAST(x.n AS int)), 0D, (s, i) -> s + x.codes[i - 1] * x.codes[i - 2]) / (x.n - 1),
        'random_change', CASE x.enc WHEN 0 THEN 0.46875D WHEN 1 THEN 0.3046875D WHEN 2 THEN 0.4012345679D ELSE 0.6425781D END))"""
    scores = f"""transform({sums}, x -> named_struct('start', x.start, 'end', x.end, 'enc', x.enc, 'n', x.n,
        'z_uniform', (x.n * (x.n - 1) / 2 * {UNEVEN} / x.k - (x.n * (x.chi2 + x.n) / x.k - x.n) / 2)
                     / sqrt(x.n * (x.n - 1) / 2 * {UNEVEN} / x.k * (1 - {UNEVEN} / x.k)),
        'z_runs', (x.changes - (x.n - 1) * {CHANGES} * x.random_change)
                  / sqrt((x.n - 1) * {CHANGES} * x.random_change * (1 - {CHANGES} * x.random_change)),
        'z_serial', (atanh({CORRELATION}D) - atanh(least(0.999999D, abs((x.lagged - x.mean * x.mean)
                    / greatest(x.square - x.mean * x.mean, 1e-9D))))) * sqrt(x.n - 3)))"""
    joint = f"""transform({scores}, x -> named_struct('start', x.start, 'end', x.end, 'enc', x.enc, 'n', x.n,
        'z', CASE WHEN least(x.z_uniform, x.z_runs, x.z_serial) <= 0 THEN 0D
             ELSE (x.z_uniform + x.z_runs + x.z_serial) / sqrt(3D) END))"""
    return f"""transform({joint}, x -> named_struct('start', x.start, 'end', x.end,
        'stratum', concat({_case(0, 'x.enc')}, '/', CAST(floor(2 * log2(x.n)) AS int)),
        'bin', CAST(least({TOP_BIN}, floor(-{BINS_PER_DECADE} * log10(greatest(1e-300D, {_normal_tail('x.z')})))) AS int)))"""


def _spans(docs: DataFrame) -> DataFrame:
    """(row, t, base, tested) of every row: the row itself, its text, and what was found there."""
    texts = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    long_enough = f"char_length(regexp_extract(x.said, '{ASSIGN.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}', 1)) >= 8"
    return (
        texts.select(
            "row",
            "t",
            F.expr(_found("t", ASSIGN, 0, long_enough)).alias("assign"),
            F.expr(_found("t", ACCESS, 1)).alias("access"),
            F.expr(_found("t", HEX, 2)).alias("hex"),
            F.expr(_found("t", CANDIDATE, 3)).alias("candidates"),
        )
        .select(
            "row",
            "t",
            F.expr("array_sort(concat(assign, access, hex))").alias("base"),
            F.expr("CASE WHEN size(candidates) > 0 THEN " + _tested("candidates") + " END").alias("tested"),
        )
        .select("row", "t", "base", F.expr("coalesce(tested, array())").alias("tested"))
    )


def thresholds(tested: DataFrame, rate: float = RATE) -> DataFrame:
    """One row with a map from stratum to the lowest bin that counts as random.

    Within a stratum (encoding and half octave of length) the step-up rule at ``rate`` runs
    over counts per bin; a bin stands for its largest p value.  There are a few dozen
    strata and at most 601 bins, whatever the size of the corpus.
    """
    counts = tested.select(F.explode("tested").alias("x")).groupBy("x.stratum", "x.bin").count()
    of = Window.partitionBy("stratum")
    ranked = counts.select(
        "stratum",
        "bin",
        F.sum("count").over(of.orderBy(F.desc("bin"))).alias("rank"),
        F.sum("count").over(of).alias("all"),
    )
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE) <= rate * F.col("rank") / F.col("all"))
    lowest = passed.groupBy("stratum").agg(F.min("bin").alias("bin"))
    return lowest.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "bin"))).alias("lowest"))


def secret_spans(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """(row, text, base, every): each row as a struct, its text, and spans (start, kind, end) by start and kind, in code points.

    ``base`` has the patterns' spans; ``every`` also the strings that pass as random and
    overlap none of them.  A null text is returned as empty, with no spans; repeated rows
    get a row each; all columns, null ids too, are kept in ``row``; an empty table gives no
    rows.
    """
    rows = _spans(docs)
    lowest = thresholds(rows.select("tested"), rate).scalar()
    plain = "transform({}, x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end))"
    return (
        rows.withColumn("lowest", lowest)
        .select(
            "row",
            F.col("t").alias("text"),
            F.expr(plain.format("base")).alias("base"),
            F.expr("""transform(filter(tested, x -> x.bin >= coalesce(lowest[x.stratum], 1000000)
                      AND NOT exists(base, b -> b.start < x.end AND x.start < b.end)),
                      x -> named_struct('start', x.start, 'kind', 3, 'end', x.end))""").alias("added"),
        )
        .select("row", "text", "base", F.expr("array_sort(concat(base, added))").alias("every"))
    )


def said(spans: str) -> F.Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')")


def redacted(text: str = "text", spans: str = "every", mask: str = "[secret]") -> F.Column:
    """The text with every span replaced by the mask; spans that meet count as one."""
    return F.expr(f"""CASE WHEN size({spans}) = 0 THEN {text} ELSE aggregate({spans},
        named_struct('at', 0L, 'out', ''),
        (a, x) -> named_struct('at', greatest(a.at, x.end),
          'out', CASE WHEN x.start < a.at OR (x.start = a.at AND a.at > 0) THEN a.out
                 ELSE concat(a.out, substring({text}, CAST(a.at + 1 AS int), CAST(x.start - a.at AS int)), '{mask}') END),
        a -> concat(a.out, substring({text}, CAST(a.at + 1 AS int)))) END""")


@query("op1_secrets")
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(columns(read(spark, sf_dir, "documents"), doc_id="long", text="string"))
    count = [F.expr(f"CAST(size(filter(base, x -> x.kind = {k})) AS bigint)").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select(
        "row.doc_id",
        *count,
        F.sha2(said("base").cast("binary"), 256).alias("base_sha256"),
        said("every").alias("spans"),
    )
