"""Secret scan: three patterns, and a randomness test battery for everything else.

Base kinds are found by pattern. The method adds ``random`` spans: maximal runs of at
least ``MIN_RUN`` characters of base64 or of base64url, padding included, whose encoding
is inferred (hexadecimal, base32, letters, letters and digits, base64) and which behave
like uniform draws from it. An '=' before more characters ends a run, so the value of
NAME=value is a run of its own, and a stretch that mixes '+' or '/' with '_' or '-' is
tested part by part in both alphabets.

Per run: a chi-squared test of uniformity over the alphabet, a runs test around the
middle of the alphabet, and a test of the serial correlation of neighbours. A run
fails the battery if the smallest of the three p-values, times three, is below
``RANDOM_LEVEL`` (it is too regular, too patterned or too lopsided for a random key).
The p-value that a secret is claimed with is the one against structured text: the
chi-squared statistic of ordinary text has a non-central distribution whose centre
grows with the length, so a short run can hardly look random by accident. These
p-values are held against a Benjamini-Hochberg threshold at rate ``FALSE_RATE``, one
threshold per encoding and doubling of the length, over the distinct runs of the corpus.
Only thresholds (a few dozen numbers) reach the driver.

Defined cases: a null text is empty and has no span; spans count code points, end
exclusive; repeated rows and ids are scanned one by one; an empty table gives no row and
no threshold. A ``random`` run inside a base span, or inside a longer ``random`` one, is
not listed again; runs of the two alphabets that only overlap are both listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from eddyline.llm.columns import gap_lengths, matches, normal_below, pieces, prefix_sums
from eddyline.llm.common import fresh, table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
MIN_ASSIGN, MIN_ACCESS, MIN_RUN = 6, 20, 20
#: Maximal runs of the base64 and of the base64url alphabet; '=' belongs to a run as trailing padding only.
RUNS = tuple(rf"(?<![{chars}])[{chars}]{{{MIN_RUN},}}(?:=+(?![A-Za-z0-9+/_=-]))?" for chars in ("A-Za-z0-9+/", "A-Za-z0-9_-"))
KINDS = ("assign", "access", "hex", "random")

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (
    ("hex", r"^[0-9]*[a-f][0-9a-f]*$", DIGITS + "abcdef"),
    ("hex_upper", r"^[0-9]*[A-F][0-9A-F]*$", DIGITS + "ABCDEF"),
    ("letters", r"^[a-z]+$", LOWER),
    ("letters_upper", r"^[A-Z]+$", UPPER),
    ("base32", r"^[A-Z2-7]+=*$", UPPER + "234567"),
    ("alnum", r"^[a-z0-9]*[a-z][a-z0-9]*$", LOWER + DIGITS),
    ("alnum_upper", r"^[A-Z0-9]*[A-Z][A-Z0-9]*$", UPPER + DIGITS),
    ("base64", r"^[A-Za-z0-9+/]*[A-Za-z][A-Za-z0-9+/]*=*$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"^[A-Za-z0-9_-]*[A-Za-z][A-Za-z0-9_-]*=*$", UPPER + LOWER + DIGITS + "-_"),
)
RANDOM_LEVEL = 0.001
FALSE_RATE = 0.05
TEXT_COLLISION, TEXT_EXCESS = 0.065, 0.7
BINS, BIN_WIDTH = 600, 0.1


def _add(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def _found(df: DataFrame, text: str, name: str, pattern: str, least: int, group: int = 0) -> DataFrame:
    """Column ``name``: array of (start, end, token) of the matches that are long enough."""
    df = df.withColumn(f"{name}_m", matches(F.col(text), pattern))
    df = df.withColumn(f"{name}_p", pieces(F.col(text), pattern, F.col(f"{name}_m")))
    df = df.withColumn(f"{name}_n", gap_lengths(F.col(f"{name}_p"), F.col(f"{name}_m")))
    df = df.withColumn(f"{name}_s", prefix_sums(F.col(f"{name}_n")))
    ends = F.zip_with(f"{name}_s", f"{name}_n", lambda s, n: s + n)
    values = matches(F.col(text), pattern, group) if group else F.col(f"{name}_m")
    spans = F.zip_with(F.arrays_zip(ends.alias("end"), F.col(f"{name}_m").alias("m")), values, lambda e, v: F.struct((e["end"] - F.length(e["m"])).alias("start"), e["end"].alias("end"), v.alias("token")))
    kept = F.filter(spans, lambda s: F.length(s["token"]) >= least)
    df = df.withColumn(name, F.when(F.size(f"{name}_m") > 0, kept).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,token:string>>")))
    return df.drop(*(f"{name}_{k}" for k in "mpns"))


def _runs(df: DataFrame, text: str) -> DataFrame:
    """Column ``runs``: the runs of both alphabets by place, those that agree once."""
    for i, pattern in enumerate(RUNS):
        df = _found(df, text, f"runs_{i}", pattern, MIN_RUN)
    both = F.array(F.array_sort(F.concat("runs_0", "runs_1")))

    def once(runs: Column) -> Column:
        def new(r: Column, i: Column) -> Column:
            last = F.get(runs, i - 1)
            return (i == 0) | (last["start"] != r["start"]) | (last["end"] != r["end"])

        return F.filter(runs, new)

    return df.withColumn("runs", F.transform(both, once)[0]).drop("runs_0", "runs_1")


def _encoding(token: Column) -> tuple[Column, Column]:
    name, alphabet = F.lit(None).cast("string"), F.lit(None).cast("string")
    for label, pattern, letters in reversed(ENCODINGS):
        name = F.when(token.rlike(pattern), F.lit(label)).otherwise(name)
        alphabet = F.when(token.rlike(pattern), F.lit(letters)).otherwise(alphabet)
    return name, alphabet


def judged(runs: Column) -> Column:
    """Array of (start, end, token, stratum, bin, random): the battery on each run."""
    inferred = F.transform(runs, lambda r: F.struct(r["start"], r["end"], r["token"], F.rtrim(r["token"], F.lit("=")).alias("body"), *(c.alias(n) for c, n in zip(_encoding(r["token"]), ("encoding", "alphabet")))))
    known = F.filter(inferred, lambda r: r["encoding"].isNotNull() & (F.length(r["body"]) * 2 >= MIN_RUN))
    coded = F.transform(known, lambda r: F.struct(r["start"], r["end"], r["token"], r["encoding"], F.length(r["alphabet"]).cast("double").alias("k"), F.transform(matches(r["body"], "."), lambda c: F.instr(r["alphabet"], c) - 1).alias("v")))
    zero, one = F.lit(0.0), F.lit(1.0)

    def squares(v: Column) -> Column:
        start = F.struct(F.lit(-1).alias("last"), zero.alias("run"), zero.alias("total"))
        step = lambda a, x: F.struct(x.alias("last"), F.when(x == a["last"], a["run"] + 1).otherwise(one).alias("run"), (a["total"] + F.when(x == a["last"], 2 * a["run"] + 1).otherwise(one)).alias("total"))
        return F.aggregate(F.array_sort(v), start, step, lambda a: a["total"])

    def sequence(v: Column, k: Column) -> Column:
        high = lambda x: (x * 2 >= k).cast("int")
        names = ("n", "high", "runs", "last", "s1", "s2", "cross")
        start = F.struct(*(c.alias(n) for c, n in zip((zero, zero, zero, F.lit(-1), zero, zero, zero), names)))

        def step(a, x):
            value, first = x.cast("double"), a["last"] < 0
            changed = F.when(first | (high(x) != high(a["last"])), one).otherwise(zero)
            cross = F.when(first, zero).otherwise(a["last"] * value)
            return F.struct(*(c.alias(n) for c, n in zip((a["n"] + 1, a["high"] + high(x), a["runs"] + changed, x, a["s1"] + value, a["s2"] + value * value, a["cross"] + cross), names)))

        return F.aggregate(v, start, step)

    counted = F.transform(coded, lambda r: F.struct(r["start"], r["end"], r["token"], r["encoding"], r["k"], squares(r["v"]).alias("squares"), sequence(r["v"], r["k"]).alias("q"), (r["v"][0] * F.element_at(r["v"], -1)).alias("wrap")))

    def statistics(r: Column) -> Column:
        q, k = r["q"], r["k"]
        n, up = q["n"], q["high"]
        chi2 = k / n * r["squares"] - n
        df = k - 1
        z_chi = (F.pow(chi2 / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        mean = 2 * up * (n - up) / n + 1
        z_runs = (q["runs"] - mean) / F.sqrt(F.nullif((mean - 1) * (mean - 2) / (n - 1), zero))
        spread = F.nullif(n * q["s2"] - q["s1"] * q["s1"], zero)
        serial = (n * (q["cross"] + r["wrap"]) - q["s1"] * q["s1"]) / spread
        z_serial = (serial + 1 / (n - 1)) / F.sqrt(n * n / ((n - 1) * (n - 1) * (n - 2)))
        extra = n * F.greatest(F.lit(TEXT_EXCESS), TEXT_COLLISION * k - 1)
        z_text = (chi2 - (df + extra)) / F.sqrt(2 * (df + 2 * extra))
        return F.struct(r["start"], r["end"], r["token"], r["encoding"], n.alias("n"), F.array(z_chi, z_runs, z_serial).alias("z"), z_text.alias("z_text"))

    def decision(r: Column) -> Column:
        least = F.aggregate(r["z"], one, lambda a, z: F.least(a, F.coalesce(2 * (1 - normal_below(F.abs(z))), zero)))
        p = F.greatest(normal_below(r["z_text"]), F.lit(1e-26))
        return F.struct(
            r["start"], r["end"], r["token"],
            F.concat_ws("/", r["encoding"], F.floor(F.log2(r["n"])).cast("string")).alias("stratum"),
            F.floor(-F.log(p) / BIN_WIDTH).cast("int").alias("bin"),
            (3 * least >= RANDOM_LEVEL).alias("random"),
        )

    return F.transform(F.transform(counted, statistics), decision)


def thresholds(texts: DataFrame, text: str, rate: float = FALSE_RATE) -> dict[str, int]:
    """Smallest bin that counts as a discovery, per stratum. A bin stands for its largest
    p-value, so the false discovery rate holds. The histogram has at most ``BINS`` rows a
    stratum, whatever the corpus; strata are encodings times doublings of the length."""
    held = F.col("t").rlike(RUNS[0]) | F.col("t").rlike(RUNS[1])
    runs = _runs(texts.select(F.col(text).alias("t")).where(held), "t")
    each = runs.select(F.explode(judged(F.col("runs"))).alias("r")).select("r.stratum", "r.bin", "r.random", F.md5(F.col("r.token")).alias("key")).distinct()
    histogram = each.groupBy("stratum", "bin").agg(F.count("*").alias("n"), F.sum(F.col("random").cast("long")).alias("passed"))
    down = Window.partitionBy("stratum").orderBy(F.col("bin").desc())
    ranked = histogram.withColumn("rank", F.sum("passed").over(down)).withColumn("m", F.sum("n").over(Window.partitionBy("stratum")))
    good = ranked.where((F.col("rank") > 0) & (F.exp(-F.col("bin") * BIN_WIDTH) <= rate * F.col("rank") / F.col("m")))
    return {r["stratum"]: r["least"] for r in good.groupBy("stratum").agg(F.min("bin").alias("least")).collect()}


def with_spans(df: DataFrame, text_col: str = "text", rate: float = FALSE_RATE) -> tuple[DataFrame, str]:
    """``df`` with one more column (its name is returned): array of (kind, start, end) by
    start, then kind as listed in ``KINDS``."""
    name = fresh(df, "secret_spans")
    hold = fresh(df, "secret_row")
    limit = thresholds(df, text_col, rate)
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(hold), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = _found(rows, "t", "assign", ASSIGN, MIN_ASSIGN, 1)
    rows = _found(rows, "t", "access", ACCESS, MIN_ACCESS)
    rows = _found(rows, "t", "hex", HEX, 24)
    rows = _runs(rows, "t")
    order = {k: i for i, k in enumerate(KINDS)}
    marked = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"], F.lit(order[kind]).alias("rank"), s["end"]))
    rows = rows.withColumn("base", F.concat(*(marked(F.col(k), k) for k in KINDS[:3])))
    if limit:
        least = F.create_map(*(F.lit(v) for pair in sorted(limit.items()) for v in pair))
        claimed = F.filter(judged(F.col("runs")), lambda r: r["random"] & (r["bin"] >= F.coalesce(least[r["stratum"]], F.lit(BINS * 10))))
        claimed = F.when(F.size("runs") > 0, claimed).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,token:string,stratum:string,bin:int,random:boolean>>"))
        rows = rows.withColumn("claimed", claimed)
        around = lambda spans, r: F.filter(spans, lambda b: (b["start"] <= r["start"]) & (b["end"] >= r["end"]))
        added = F.filter("claimed", lambda r: (F.size(around("base", r)) == 0) & (F.size(around("claimed", r)) == 1))
        rows = rows.withColumn("all", F.array_sort(F.concat("base", marked(added, "random"))))
    else:
        rows = rows.withColumn("all", F.array_sort("base"))
    kinds = F.array(*(F.lit(k) for k in KINDS))
    spans = F.transform("all", lambda s: F.struct(kinds[s["rank"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select(f"{hold}.*", spans.alias(name)), name


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", count_col: str | None = None) -> DataFrame:
    """``df`` with every span replaced by ``mark`` (spans that touch or overlap become one).
    ``count_col``, if given, is set to the new number of code points where text changed."""
    found, name = with_spans(df, text_col)
    merged = F.aggregate(
        name,
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] <= F.try_element_at(acc, F.lit(-1))["end"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.array_append(acc, F.struct(s["start"].alias("start"), s["end"].alias("end")))),
    )
    spans = fresh(found, "secret_merged")
    found = found.withColumn(spans, F.when(F.size(name) > 0, merged))
    text = F.col(text_col)
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(spans, lambda s: s["end"]))
    stops = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text).cast("bigint")))
    kept = F.zip_with(starts, stops, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    clean = F.when(F.col(spans).isNotNull(), F.array_join(kept, mark)).otherwise(text)
    changed = {text_col: clean}
    if count_col:
        size = F.aggregate(spans, F.length(text).cast("bigint"), lambda n, s: n - (s["end"] - s["start"]) + len(mark))
        changed[count_col] = F.when(F.col(spans).isNotNull(), size).otherwise(F.col(count_col)).cast(dict(df.dtypes)[count_col])
    return found.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in df.columns))


def op1_secret_battery(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, name = with_spans(docs)
    base = F.filter(name, lambda s: s["kind"] != KINDS[3])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda kind: F.filter(name, lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    digest = F.sha2(joined(base).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts[:3], digest, joined(F.col(name)).alias("spans"), counts[3])
