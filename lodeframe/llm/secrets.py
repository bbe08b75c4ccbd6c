"""Secret scans in DataFrame functions only: fixed patterns, and a battery of randomness tests on long tokens."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.llm.scratch import cut, unused

#: Kind, pattern, group whose length counts, least length. Their order is the order of kinds.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Candidates of the battery: whole runs of the base64 alphabets. Fixed values.
LEAST_RANDOM = 20
TOKEN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST_RANDOM},}}={{0,2}}"
#: A text without any of this holds no span of any kind: one pass leaves most texts. Fixed values, as in BASE.
MAY = rf"""[A-Za-z0-9+/_-]{{{LEAST_RANDOM}}}|(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
#: Encoding: what its tokens match, its alphabet, how often two characters of ordinary text in it agree, and how often
#: two neighbours in mixed ordinary text are of classes that words and names seldom join (ODD); None: not looked at.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef", 0.20, None),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF", 0.20, None),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.066, None),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.066, 0.12),
)
_CLASSES = "U" * 26 + "l" * 26 + "d" * 10 + "ss"
#: Two capitals, a capital and a digit, a digit and a letter: 0.35 of the pairs in random base64.
ODD = "(?=UU|Ud|dU|dl)"
#: Each test of the battery may reject a truly random token this often.
ALPHA = 1e-3
#: Families of the discovery control: tokens of the make of their encoding, by encoding and by these least lengths.
LENGTHS = (20, 24, 28, 32, 40, 64)
#: What the p-value may be at most for a token that is found in its family alone.
MOST_TEXT = 0.003
#: Share of false finds among the added spans that is aimed at.
FDR = 0.01
MASK = "<SECRET>"
_BINS, _BIN = 2000, 100
_PREFIX = 256
#: Characters of a text or a token that are looked at together.
_PIECE = 4096


def running(lens: Column) -> Column:
    """Running sums of an int array, in chunks: the work grows as n * 256, not as n squared."""
    m = F.size(lens)
    part = F.transform(F.sequence(F.lit(0), F.floor((m - 1) / _PREFIX).cast("int")), lambda c: F.slice(lens, c * _PREFIX + 1, F.lit(_PREFIX)))

    def inner(x):
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(x, start, lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"] + v)).alias("out")))["out"]

    def outer(acc, x):
        y = F.transform(inner(x), lambda v: v + acc["at"])
        return F.struct(F.element_at(y, -1).alias("at"), F.concat(acc["out"], F.array(y)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    return F.flatten(F.aggregate(part, start, outer)["out"])


_EMPTY = "array<struct<start:int,rank:int,end:int,length:int,token:string>>"


def with_matches(df: DataFrame, name: str, pattern: str, group: int, rank: int, guard: Column) -> DataFrame:
    """Adds column ``name``: every leftmost match of ``pattern`` in ``text`` as (start, rank, end, length of
    the group, match), in code points. Lengths of what the pattern splits off give the positions."""
    none = F.array().cast("array<string>")
    df = df.withColumn("_m", F.when(guard, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("_g", F.when(F.size("_m") > 0, F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).otherwise(none) if group else F.col("_m"))
    lens = F.flatten(F.zip_with(F.split("text", pattern, -1), "_m", lambda p, m: F.array(F.length(p), F.coalesce(F.length(m), F.lit(0)))))
    df = df.withColumn("_l", F.when(F.size("_m") > 0, lens))
    df = df.withColumn("_e", F.when(F.size("_m") > 0, running(F.col("_l"))))

    def span(i):
        return F.struct(F.get("_e", i * 2).alias("start"), F.lit(rank).alias("rank"), F.get("_e", i * 2 + 1).alias("end"), F.length(F.get("_g", i)).alias("length"), F.get("_m", i).alias("token"))

    found = F.transform(F.sequence(F.lit(0), F.size("_m") - 1), span)
    return df.withColumn(name, F.when(F.size("_m") > 0, found).otherwise(F.array().cast(_EMPTY))).drop("_m", "_g", "_l", "_e")


def _below(z: Column) -> Column:
    """Standard normal distribution function."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z > 0, 1 - tail).otherwise(tail)


def pieces(text: Column) -> Column:
    """A text in pieces of _PIECE characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))


def _sums(piece: Column) -> Column:
    """What the battery needs of a piece of a token: sums over its codes, over codes that follow each other, and
    over whether they lie in the upper half of the alphabet."""
    x = F.transform(F.split(piece, ""), lambda c: F.call_function("instr", F.col("_abc"), c).cast("double") - 1)

    def of(x):
        up = F.transform(x, lambda v: v * 2 >= F.col("_k"))
        pairs = F.zip_with(F.slice(x, 2, F.lit(_PIECE)), F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: a * b)
        turns = F.zip_with(F.slice(up, 2, F.lit(_PIECE)), F.slice(up, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: F.when(a != b, 1.0).otherwise(0.0))
        total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, v: a + v)
        return F.struct(
            F.size(x).cast("double").alias("n"), total(x).alias("s1"), total(F.transform(x, lambda v: v * v)).alias("s2"), total(pairs).alias("lag"), F.get(x, F.lit(0)).alias("first"), F.get(x, F.size(x) - 1).alias("last"),
            F.size(F.filter(up, lambda u: u)).cast("double").alias("high"), total(turns).alias("turns"),
        )

    return F.get(F.transform(F.array(x), of), F.lit(0))


def battery(tokens: DataFrame) -> DataFrame:
    """Adds to ``tokens(token)``: ``encoding``, ``p_uniform``, ``p_runs``, ``p_serial`` (that a random token of
    this encoding looks no more regular), and ``p_text`` (that ordinary text of this length would agree
    with itself as seldom); ``p_text`` is 1 if any test of the battery rejects randomness. ``mixed`` tells
    whether upper and lower case, digits and signs stand in the token as in random text of its encoding; words
    of one case never do, whatever letters they are made of. ``p_mixed``: for such tokens, ``p_text`` combined by
    Fisher's rule with the chance that mixed ordinary text holds as many odd pairs, where the encoding says how often it does.

    A token is taken in pieces, so that a very long one is never held as an array of numbers."""
    t, enc, size, alphabet, ic, change = F.col("token"), F.lit(ENCODINGS[-1][0]), F.lit(64.0), F.lit(ENCODINGS[-1][2]), F.lit(ENCODINGS[-1][3]), F.lit(ENCODINGS[-1][4])
    for name, like, signs, agree, turn in reversed(ENCODINGS[:-1]):
        hit = t.rlike(like)
        enc, size, alphabet, ic = F.when(hit, name).otherwise(enc), F.when(hit, float(len(signs))).otherwise(size), F.when(hit, signs).otherwise(alphabet), F.when(hit, agree).otherwise(ic)
        change = F.when(hit, F.lit(turn).cast("double")).otherwise(change)
    # base64url's - and _ are + and / again
    df = tokens.withColumn("encoding", enc).withColumn("_k", size).withColumn("_abc", alphabet).withColumn("_ic", ic).withColumn("_change", change).withColumn("_body", F.translate(F.regexp_replace("token", "=+$", ""), "-_", "+/"))
    body, length = F.col("_body"), F.length("_body").cast("double")
    # signs of each class, as the encoding's alphabet has them; chi-squared at 0.001 with 1 and 3 degrees of freedom
    counts = [F.length(F.regexp_replace(body, f"[^{c}]", "")).cast("double") for c in ("A-Z", "a-z", "0-9", "+/")]

    def like(shares, bar):
        terms = [F.pow(c - length * share, F.lit(2.0)) / (length * share) for c, share in zip(counts, shares, strict=True) if share]
        off = terms[0]
        for x in terms[1:]:
            off = off + x
        present = F.lit(True)
        for c, share in zip(counts, shares, strict=True):
            if share > 0.1:
                present = present & (c > 0)
        return present & (off < bar)

    mixed = F.when(F.col("encoding") == "hex", like((0, 6 / 16, 10 / 16, 0), 10.83)).when(F.col("encoding") == "HEX", like((6 / 16, 0, 10 / 16, 0), 10.83))
    mixed = mixed.when(F.col("encoding") == "base32", like((26 / 32, 0, 6 / 32, 0), 10.83)).otherwise(like((26 / 64, 26 / 64, 10 / 64, 2 / 64), 16.27))
    df = df.withColumn("mixed", mixed)
    # how often each sign of the alphabet stands in the token
    often = F.transform(F.filter(F.split("_abc", ""), lambda c: c != ""), lambda c: (F.length("_body") - F.length(F.replace(F.col("_body"), c, F.lit("")))).cast("double"))
    df = df.withColumn("_sq", F.aggregate(often, F.lit(0.0), lambda acc, v: acc + v * v)).withColumn("_s", F.transform(pieces(body), _sums))
    total = lambda f: F.aggregate("_s", F.lit(0.0), lambda acc, v: acc + v[f])
    seam = F.transform(F.sequence(F.lit(1), F.size("_s") - 1), lambda i: F.struct(F.get("_s", i)["first"].alias("a"), F.get("_s", i - 1)["last"].alias("b")))
    df = df.withColumn("_seam", F.when(F.size("_s") > 1, seam).otherwise(F.array().cast("array<struct<a:double,b:double>>")))
    k = F.col("_k")
    over = lambda f: F.aggregate("_seam", F.lit(0.0), lambda acc, v: acc + f(v))
    df = df.withColumn("_n", total("n")).withColumn("_n1", total("high")).withColumn("_n0", F.col("_n") - F.col("_n1"))
    df = df.withColumn("_runs", 1.0 + total("turns") + over(lambda v: F.when((v["a"] * 2 >= k) != (v["b"] * 2 >= k), 1.0).otherwise(0.0)))
    df = df.withColumn("_mean", total("s1") / F.col("_n")).withColumn("_chi", k / F.col("_n") * F.col("_sq") - F.col("_n"))
    mean, ends = F.col("_mean"), F.get("_s", F.lit(0))["first"] + F.element_at("_s", -1)["last"]
    df = df.withColumn("_var", total("s2") - F.col("_n") * mean * mean)
    df = df.withColumn("_lag", total("lag") + over(lambda v: v["a"] * v["b"]) - mean * (2 * total("s1") - ends) + (F.col("_n") - 1) * mean * mean)
    n, n1, n0 = F.col("_n"), F.col("_n1"), F.col("_n0")
    # Wilson and Hilferty's normal form of chi-squared
    d = 2 / (9 * (k - 1))
    z_chi = (F.pow(F.greatest(F.col("_chi"), F.lit(0.0)) / (k - 1), F.lit(1 / 3)) - (1 - d)) / F.sqrt(d)
    mu = 1 + 2 * n1 * n0 / n
    var = F.greatest((mu - 1) * (mu - 2) / (n - 1), F.lit(0.25))
    z_runs = F.when((n1 > 0) & (n0 > 0), (F.col("_runs") - mu) / F.sqrt(var)).otherwise(9.0)
    z_serial = F.when(F.col("_var") > 1e-9, (F.col("_lag") / F.col("_var") + 1 / n) * F.sqrt(n)).otherwise(9.0)
    df = df.withColumn("p_uniform", 1 - _below(z_chi)).withColumn("p_runs", 2 * _below(-F.abs(z_runs))).withColumn("p_serial", 2 * _below(-F.abs(z_serial)))
    # pairs of places that agree: under ordinary text about ic of them, spread half as wide again
    agreeing = (F.col("_sq") - n) / 2
    pairs = n * (n - 1) / 2
    z_text = (agreeing + 0.5 - pairs * F.col("_ic")) / (1.5 * F.sqrt(pairs * F.col("_ic") * (1 - F.col("_ic"))))
    fails = (F.col("p_uniform") < ALPHA) | (F.col("p_runs") < ALPHA) | (F.col("p_serial") < ALPHA)
    least = F.lit(1e-300)
    df = df.withColumn("p_text", F.when(fails, 1.0).otherwise(F.greatest(_below(z_text), least)))
    odd = F.regexp_count(F.translate(body, ENCODINGS[-1][2], _CLASSES), F.lit(ODD))
    z_odd = (odd - 0.5 - (n - 1) * F.col("_change")) / F.sqrt((n - 1) * F.col("_change") * (1 - F.col("_change")))
    both = F.greatest(F.col("p_text") * _below(-z_odd), least)
    df = df.withColumn("p_mixed", F.when(F.col("_change").isNull() | (F.col("p_text") >= 1), F.col("p_text")).otherwise(F.least(both * (1 - F.log(both)), F.lit(1.0))))
    return df.drop("_k", "_abc", "_ic", "_change", "_body", "_sq", "_s", "_seam", "_n", "_n1", "_n0", "_runs", "_mean", "_chi", "_var", "_lag")


def _bin(p: Column) -> Column:
    return F.least(F.floor(-F.log10(p) * _BIN), F.lit(_BINS)).cast("int")


def discovery_bin(histogram: list[tuple[int, int]], rate: float) -> int:
    """Benjamini and Hochberg's step-up over p-values in bins of falling p: the least bin whose largest
    p-value times the number of tests is at most ``rate`` times the number of finds from it on."""
    total, found, least = sum(n for _, n in histogram), 0, _BINS + 1
    for b, n in sorted(histogram, reverse=True):
        found += n
        if 10 ** (-b / _BIN) * total <= rate * found:
            least = b
    return least


def _clear(finds: DataFrame) -> DataFrame:
    """The tokens that no base span of their row touches, one a row; a row's spans are sorted, not compared with each other."""
    slot = "array<struct<start:int,end:int,token:string,base:boolean>>"
    tokens = F.transform("tokens", lambda t: F.struct(t["start"], t["end"], t["token"], F.lit(False)))
    base = F.transform("base", lambda b: F.struct(b["start"], b["end"], F.lit(""), F.lit(True)))
    spans = finds.where(F.size("tokens") > 0).select("row", F.explode(F.concat(tokens.cast(slot), base.cast(slot))).alias("s")).select("row", "s.*")
    before = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("_end", F.max(F.when(F.col("base"), F.col("end"))).over(before)).withColumn("_next", F.min(F.when(F.col("base"), F.col("start"))).over(after))
    free = (F.col("_end").isNull() | (F.col("_end") <= F.col("start"))) & (F.col("_next").isNull() | (F.col("_next") >= F.col("end")))
    return spans.where(~F.col("base") & free).select("row", "start", F.lit(len(BASE)).alias("rank"), "end", "token")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FDR) -> DataFrame:
    """One row per input row: ``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans, random_spans``.

    A null text is an empty one; without finds the counts are 0, ``spans`` is '' and the digest that of
    ''. Base spans are the whole matches. The battery adds whole tokens of 20 characters or more that
    no base span touches: those that pass for random in their inferred encoding, where ordinary text of
    that length would look so only so often that about ``rate`` of the added spans
    are false. The families of tests are all tokens of the table; and, for each encoding and length, the
    tokens whose classes of signs are those of their encoding, where at most MOST_TEXT passes, so
    that these don't depend on how many ordinary long words the table holds. Any family may add a span. Repeated rows are each scanned; an empty table
    gives an empty result; other columns are not read.

    The texts are scanned once; a table of finds, without texts, then gives the histogram of p-values
    (a fixed number of bins for each family) and the result.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("_may", F.col("text").rlike(MAY))
    text, may = F.col("text"), F.col("_may")
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        guard = text.contains("AKIA") if kind == "access" else text.rlike(pattern)
        df = with_matches(df, kind, pattern, group, rank, may & guard)
        df = df.withColumn(kind, F.filter(kind, lambda s: s["length"] >= least))
    df = with_matches(df, "tokens", TOKEN, 0, len(BASE), may & text.rlike(TOKEN))
    df = df.withColumn("base", F.concat(*[F.col(k) for k, *_ in BASE]))
    slim = "array<struct<start:int,rank:int,end:int>>"
    finds = df.select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k, *_ in BASE], F.array_sort(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))).cast(slim).alias("base"), "tokens", F.expr("uuid()").alias("row"))
    finds = cut(finds, "finds")
    n, family = F.length("token"), F.lit(0)
    for least in LENGTHS:
        family = F.when(n >= least, least).otherwise(family)
    tried = battery(_clear(finds)).withColumn("family", F.concat_ws(":", "encoding", family))
    tried = cut(tried.select("row", "start", "rank", "end", "mixed", "family", "p_text", "p_mixed"), "tried")
    together = [(r.b, r.n) for r in tried.groupBy(_bin(F.col("p_text")).alias("b")).agg(F.count("*").alias("n")).collect()]
    bar = discovery_bin(together, rate)
    apart: dict[str, list[tuple[int, int]]] = {}
    for r in tried.where("mixed").groupBy("family", _bin(F.col("p_mixed")).alias("b")).agg(F.count("*").alias("n")).collect():
        apart.setdefault(r.family, []).append((r.b, r.n))
    least = math.ceil(-math.log10(MOST_TEXT) * _BIN)
    bars = F.create_map(*[x for k, h in sorted(apart.items()) for x in (F.lit(k), F.lit(max(discovery_bin(h, rate), least)))]) if apart else F.create_map().cast("map<string,int>")
    passes = (_bin(F.col("p_text")) >= bar) | F.coalesce(F.col("mixed") & (_bin(F.col("p_mixed")) >= bars[F.col("family")]), F.lit(False))
    added = tried.where(passes).groupBy("row").agg(F.collect_list(F.struct("start", "rank", "end")).alias("added"))
    out = finds.drop("tokens").join(added, "row", "left").withColumn("added", F.coalesce(F.col("added"), F.array()).cast(slim))
    names = F.array(*[F.lit(k) for k, *_ in BASE], F.lit("random"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    return out.select(
        "doc_id", *[f"n_{k}" for k, *_ in BASE], F.size("added").cast("bigint").alias("n_random"), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"), joined(F.array_sort("added")).alias("random_spans"),
    )


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """``text`` with each of ``spans`` (a, z), sorted and apart, replaced by ``mask``; piece by piece, so the work grows
    as the text, not as the text times its spans."""

    def part(piece, j):
        low = j * _PIECE
        own = F.filter(spans, lambda s: (s["z"] > low) & (s["a"] < low + _PIECE))

        def of(own):
            start = lambda i: F.when(i == 0, low).otherwise(F.get(own, i - 1)["z"])
            kept = F.transform(own, lambda s, i: F.concat(F.substring(piece, start(i) - low + 1, F.greatest(s["a"] - start(i), F.lit(0))), F.when(s["a"] >= low, F.lit(mask)).otherwise(F.lit(""))))
            last = F.when(F.size(own) > 0, F.get(own, F.size(own) - 1)["z"]).otherwise(low)
            return F.concat(F.array_join(kept, ""), F.substring(piece, last - low + 1, F.lit(_PIECE)))

        return F.get(F.transform(F.array(own), of), F.lit(0))

    return F.array_join(F.transform(pieces(text), part), "")


def redacted(docs: DataFrame, text_col: str = "text", mask: str = MASK, rate: float = FDR) -> DataFrame:
    """The rows and columns of ``docs`` with every found span of ``text_col`` replaced by ``mask``; spans that
    overlap are replaced as one. Texts without finds, null ones among them, stay as they are, as do all other columns, whatever their names."""
    kept, text = [f"`{c}`" for c in docs.columns], F.col(f"`{text_col}`")
    may = F.coalesce(text.rlike(MAY), F.lit(False))
    key, found, spans = (unused(docs, f"_lodeframe_{x}") for x in ("key", "found", "spans"))
    # spans depend on the text alone, so a text is its own key; only rows that may hold one are written and joined
    digest = F.sha2(text.cast("binary"), 256)
    some = cut(docs.where(may), "may")
    hits = scan(some.select(digest.alias("key"), text.alias("text")), "key", "text", rate).where("spans <> ''").groupBy("doc_id").agg(F.max("spans").alias("spans"))
    part = F.split("s", ":")
    each = hits.select("doc_id", F.explode(F.split("spans", ",")).alias("s")).select("doc_id", F.get(part, F.lit(1)).cast("int").alias("a"), F.get(part, F.lit(2)).cast("int").alias("z"))
    earlier = Window.partitionBy("doc_id").orderBy("a", "z")
    each = each.withColumn("end", F.max("z").over(earlier.rowsBetween(Window.unboundedPreceding, -1)))
    each = each.withColumn("group", F.sum(F.when(F.col("end") > F.col("a"), 0).otherwise(1)).over(earlier.rowsBetween(Window.unboundedPreceding, 0)))
    apart = each.groupBy("doc_id", "group").agg(F.min("a").alias("a"), F.max("z").alias("z")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("a", "z"))).alias(spans))
    apart = cut(apart.withColumnRenamed("doc_id", found), "spans")
    df = some.withColumn(key, digest).join(apart, F.col(key) == F.col(found), "left")
    done = df.withColumn(text_col, F.when(F.col(found).isNotNull(), masked(text, F.col(spans), mask)).otherwise(text)).select(*kept)
    return docs.where(~may).unionByName(done)
