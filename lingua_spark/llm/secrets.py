"""Secret scans with a randomness test battery (operator 7). DataFrame functions only.

Base kinds, leftmost non-overlapping: assign, access, hex. The battery adds spans of kind random: maximal runs of
MIN_TOKEN or more base64-like characters with a letter and a digit. From the characters an encoding is inferred (hex,
base 32, 36, 62 or 64), which fixes the alphabet, and three tests must accept the run as uniform noise over it:
chi-squared uniformity (Wilson-Hilferty), the runs test about the alphabet's middle, and the lag-1 serial correlation.
A run of words passes none of them reliably when short, so each run also gets a p-value under the hypothesis "text":
the number of equal character pairs, compared with its mean and variance for text of that length (TEXT_PAIRS,
TEXT_TRIPLES). Benjamini and Hochberg's rule at FALSE_DISCOVERIES over all runs of the corpus, on a histogram of the
p-values (rounded up), decides; longer runs can reach smaller p-values, short ones need a pure corpus.

Scale: documents are read once; only spans, their lengths and statistics leave the scan. Positions are running sums per
document and kind. The histogram has at most a few thousand rows, whatever the input.

Defined cases: null texts are empty; a document without spans has zero counts and the digest of the empty string;
repeated rows each get a row; texts are scanned whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lingua_spark.llm.common import cut_lineage

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 characters or more
HEX = r"[0-9a-f]{24,}"         # [0-9a-f]+ of 24 characters or more
MIN_TOKEN = 20
TOKEN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}+={{0,2}}"

#: Chance that two, and three, characters of text are equal; for hex digits, of words spelt in them.
TEXT_PAIRS, TEXT_TRIPLES = 0.066, 0.0055
HEX_PAIRS, HEX_TRIPLES = 0.15, 0.03
FALSE_DISCOVERIES = 0.05
#: Standard errors beyond which a test rejects noise.
REJECT_NOISE = 3.1
#: Histogram steps per power of ten of a p-value.
STEPS = 8

#: (expression of the run, alphabet), the first that fits
_ENCODINGS = (
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)


def _found(text: Column, kind: int, pattern: str, keep: Column | None = None) -> Column:
    """Array of (kind, at, gap, len, ok, value): each match with the number of characters since the match before."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    oks = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda g: F.length(g) >= 6) if kind == 0 else F.transform(
        matches, lambda m: F.lit(True))
    both = F.arrays_zip(matches.alias("m"), F.slice(gaps, F.lit(1), F.size(matches)).alias("g"), oks.alias("ok"))
    rows = F.transform(both, lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("at"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), x["ok"].alias("ok"),
        (x["m"] if kind == 3 else F.lit(None).cast("string")).alias("value")))
    none = F.array().cast("array<struct<kind: int, at: int, gap: int, len: int, ok: boolean, value: string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), rows).otherwise(none)


def _normal_tail(z: Column) -> Column:
    """P(Z <= z) for z <= 0 (Abramowitz and Stegun 26.2.17); 0.5 above."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z < 0, F.exp(-x * x / 2) * 0.3989422804014327 * poly).otherwise(F.lit(0.5))


def battery(rows: DataFrame) -> DataFrame:
    """rows(value, ...) with noise (the three tests accept) and step (histogram step of the p-value under "text");
    both null for values without a letter or a digit, or shorter than MIN_TOKEN without padding."""
    v = F.translate(F.regexp_replace("value", "=+$", ""), "-_", "+/")
    alphabet = F.coalesce(*(F.when(F.regexp_like("v", F.lit(p)), F.lit(a)) for p, a in _ENCODINGS[:-1]), F.lit(_ENCODINGS[-1][1]))
    fits = (F.length("v") >= MIN_TOKEN) & F.regexp_like("v", F.lit("[0-9]")) & F.regexp_like("v", F.lit("[A-Za-z]"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    out = (rows.withColumn("v", v).withColumn("v", F.when(fits, F.col("v"))).withColumn("a", F.when(F.col("v").isNotNull(), alphabet))
           .withColumn("k", F.length("a")).withColumn("n", F.length("v"))
           .withColumn("x", F.transform(F.filter(F.split("v", ""), lambda c: c != ""), lambda c: (F.instr(F.col("a"), c) - 1).cast("double")))
           .withColumn("pairs2", F.aggregate(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.size(F.filter("x", lambda y: y == j))),
                                             F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))))
    df = k - 1
    chi = k * F.col("pairs2") / n - n
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    high = F.transform("x", lambda y: y >= k / 2)
    n1 = F.size(F.filter(high, lambda h: h)).cast("double")
    both = 2 * n1 * (n - n1)
    changes = F.size(F.filter(F.zip_with(F.slice(high, F.lit(1), F.col("n") - 1), F.slice(high, F.lit(2), F.col("n") - 1), lambda p, q: p != q), lambda h: h))
    runs_var = both * (both - n) / (n * n * (n - 1))
    z_runs = (1 + changes - (1 + both / n)) / F.sqrt(F.greatest(runs_var, F.lit(1e-9)))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, y: s + y)
    out = out.withColumn("mean", total(F.col("x")) / n)
    dev = lambda y: y - F.col("mean")
    serial = total(F.zip_with(F.slice("x", F.lit(1), F.col("n") - 1), F.slice("x", F.lit(2), F.col("n") - 1), lambda p, q: dev(p) * dev(q)))
    spread = total(F.transform("x", lambda y: dev(y) * dev(y)))
    z_serial = serial / F.greatest(spread, F.lit(1e-9)) * F.sqrt(n)
    is_hex = F.col("k") == 16
    pair, triple = (F.when(is_hex, F.lit(h)).otherwise(F.lit(t)) for h, t in ((HEX_PAIRS, TEXT_PAIRS), (HEX_TRIPLES, TEXT_TRIPLES)))
    pairs = n * (n - 1) / 2
    var = pairs * pair * (1 - pair) + n * (n - 1) * (n - 2) * F.greatest(triple - pair * pair, F.lit(0.0))
    z_text = ((F.col("pairs2") - n) / 2 + 0.5 - pairs * pair) / F.sqrt(var)
    noise = (F.col("z_chi") <= REJECT_NOISE) & (F.abs("z_runs") <= REJECT_NOISE) & (F.abs("z_serial") <= REJECT_NOISE)
    p = F.greatest(_normal_tail(F.col("z_text")), F.lit(1e-300))
    return (out.withColumn("z_chi", z_chi).withColumn("z_runs", z_runs).withColumn("z_serial", z_serial).withColumn("z_text", z_text)
            .withColumn("noise", F.when(F.col("v").isNotNull(), noise))
            .withColumn("step", F.when(F.col("v").isNotNull(), F.floor(-F.log10(p) * STEPS).cast("int")))
            .drop("v", "a", "k", "n", "x", "pairs2", "mean", "z_chi", "z_runs", "z_serial", "z_text"))


def discovery_step(steps: DataFrame) -> int | None:
    """The smallest histogram step that Benjamini and Hochberg's rule accepts; None if it accepts nothing."""
    hist = steps.where("step is not null").groupBy("step").agg(F.count("*").alias("c"))
    above = F.sum("c").over(W.orderBy(F.col("step").desc()))
    ruled = hist.withColumn("found", above).withColumn("all", F.sum("c").over(W.partitionBy()))
    return (ruled.where(F.pow(F.lit(10.0), -F.col("step") / STEPS) <= FALSE_DISCOVERIES * F.col("found") / F.col("all"))
            .agg(F.min("step")).first()[0])


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base, spans) per document; base and spans are
    arrays of (start, kind, end), by start, then kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = F.concat(*(_found(F.col("text"), k, p) for k, p in enumerate((ASSIGN, ACCESS, HEX, TOKEN))))
    rows = (docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
            .select("row", "doc_id", F.explode_outer(found).alias("f")).select("row", "doc_id", "f.*"))
    rows = cut_lineage(battery(rows.withColumn("value", F.when(F.col("kind") == 3, F.col("value")))).drop("value"))
    step = discovery_step(rows)
    keep = F.col("ok") & ((F.col("kind") < 3) | (F.coalesce(F.col("noise"), F.lit(False)) & (F.col("step") >= F.lit(step if step is not None else 1 << 30))))
    end = F.sum(F.col("gap") + F.col("len")).over(W.partitionBy("row", "kind").orderBy("at"))
    spans = (rows.repartition("row").withColumn("end", end.cast("long"))
             .withColumn("span", F.when(keep, F.struct((F.col("end") - F.col("len")).alias("start"), "kind", "end"))))
    count = lambda k: F.count(F.when((F.col("kind") == k) & F.col("span").isNotNull(), 1)).alias(f"n_{KINDS[k]}")
    return (spans.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *(count(k) for k in range(4)),
                                     F.array_sort(F.collect_list("span")).alias("spans"))
            .withColumn("base", F.filter("spans", lambda s: s["kind"] < 3)).drop("row"))


def span_text(spans: str) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    return secret_spans(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(span_text("base"), 256).alias("base_sha256"),
                                     span_text("spans").alias("spans"), "n_random")
