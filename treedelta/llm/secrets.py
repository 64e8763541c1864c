r"""Secret scans: base patterns and a randomness test battery, in DataFrame operations only.

Three patterns give the base spans.  The battery looks at every other run of 20 or more characters
of [A-Za-z0-9+/_-], with up to two '=' of padding at its end, and infers its encoding from the characters in it.  Two
questions are asked.  Could the token be a uniform random string over the encoding's alphabet?
Chi-squared uniformity of the characters, runs above and below the alphabet's middle, and lag-one
serial correlation say so, joined by Fisher's method; below RANDOM_LEVEL it is no candidate.  Could it
be text?  Text repeats characters more often, and changes less often between small letters, capitals,
digits and signs; the tails of both counts under a model of text are joined by Fisher's method as well.

The claims "this isn't text" are then sorted out by the Benjamini-Hochberg rule within each pair of
encoding and length class, over the tokens of all texts: of the secrets found in a class no more than
the stated share is expected to be text.  Short tokens differ less from text, so the rule finds fewer of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, named, table

#: The base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGNED = 12

#: '=' counts as padding where no token follows it; behind a name it separates the name from its value.
TOKEN = r"[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
#: Alphabets in their usual order, the narrowest first.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Expected share of text among the secrets found in a class of encoding and length.
FDR = 0.05
#: Tokens for which the battery's joint p-value is lower aren't random strings.
RANDOM_LEVEL = 1e-3
#: The model of text: the chance that two characters are equal, what the third moment adds to the
#: variance of such pairs, and the share of places at which the kind of character changes.
TEXT_EQUAL, TEXT_THIRD, TEXT_CHANGES = 0.0667, 0.0011, 0.2
#: Spans are placed in blocks of so many matches.
BLOCK = 256
#: p-values are counted by steps of 1/20 of -ln p, up to 40.
P_STEPS, P_MOST = 20, 40


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _log_p_two_sided(z: Column) -> Column:
    """ln of P(|Z| > |z|) for a standard normal Z, by the logistic approximation with a cubic term."""
    a = F.abs(z)
    return F.log(F.lit(2.0)) - F.log1p(F.exp(F.least(1.5976 * a + 0.070565416 * a * a * a, F.lit(300.0))))


def _log_p_upper(z: Column) -> Column:
    """ln of P(Z > z)."""
    return -F.log1p(F.exp(F.least(F.greatest(1.5976 * z + 0.070565416 * z * z * z, F.lit(-300.0)), F.lit(300.0))))


def _squares(token: Column) -> Column:
    """The sum of squared counts of the token's characters."""
    return F.aggregate(F.array_distinct(F.split(token, "")), F.lit(0.0), lambda acc, c: acc + F.pow((F.length(token) - F.length(F.replace(token, c, F.lit("")))).cast("double"), F.lit(2.0)))


def _minus_log_p(token: Column, alphabet: Column, squares: Column) -> Column:
    """-ln of Fisher's joint p-value of the three tests of randomness, 0 or more; the token is at least two characters."""
    n, size = F.length(token).cast("double"), F.length(alphabet).cast("double")
    df = size - 1
    # Wilson and Hilferty: the cube root of chi2 / df is nearly normal.
    uniform = _let((F.cbrt((squares * size / n - n) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)), _log_p_upper)
    codes = F.transform(F.split(token, ""), lambda c: F.instr(alphabet, c) - (size + 1) / 2)
    start = F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("product"), F.lit(0.0).alias("turn"))
    step = lambda acc, x: F.struct(x.alias("last"), (acc["product"] + acc["last"] * x).alias("product"), (acc["turn"] + (acc["last"] * x < 0).cast("double")).alias("turn"))
    chain = lambda sums: _log_p_two_sided((sums["turn"] - (n - 1) / 2) / F.sqrt((n - 1) / 4)) + _log_p_two_sided(sums["product"] / (F.sqrt(n - 1) * (size * size - 1) / 12))
    order = _let(F.aggregate(codes, start, step), chain)
    # Half of Fisher's statistic, which has 6 degrees of freedom.
    joint = lambda half: F.greatest(half - F.log1p(half + half * half / 2), F.lit(0.0))
    return _let(-(uniform + order), joint)


def _minus_log_text(token: Column, alphabet: Column, squares: Column) -> Column:
    """-ln of Fisher's joint p-value of the two tests of text, 0 to P_MOST."""
    n, size = F.length(token).cast("double"), F.length(alphabet).cast("double")
    # Small alphabets: text in them, such as numbers in hex, repeats characters more often than letters do.
    equal = F.greatest(F.lit(TEXT_EQUAL), 1.5 / size)
    mean = n * (n - 1) * equal
    spread = F.sqrt(4 * n * (n - 1) * (n - 2) * TEXT_THIRD + 2 * n * (n - 1) * (equal - equal * equal))
    repeats = _log_p_upper((mean - (squares - n)) / spread)
    # Letters of one case change to digits less often than mixed ones change at all.
    rate = F.when((F.lower(alphabet) == alphabet) | (F.upper(alphabet) == alphabet), F.lit(TEXT_CHANGES / 2)).otherwise(F.lit(TEXT_CHANGES))
    places = n - 1
    seen = (F.regexp_count(token, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")) - 1).cast("double")

    def tail(share: Column) -> Column:
        """ln of a bound of the binomial tail that is never too low: Chernoff's, or by the first term and the ratio of terms."""
        stays = F.greatest(1 - share, F.lit(1e-9))
        chernoff = -places * (share * F.log(share / rate) + stays * F.log(stays / (1 - rate)))
        sharper = chernoff - F.log(2 * math.pi * places * share * stays) / 2 + F.log((seen + 1) * (1 - rate) / F.greatest(seen + 1 - n * rate, F.lit(1e-9)))
        return F.when(share <= rate, F.lit(0.0)).otherwise(F.least(chernoff, sharper))

    changes = _let(F.greatest(seen / places, rate), tail)
    joint = lambda half: F.least(F.greatest(half - F.log1p(half), F.lit(0.0)), F.lit(float(P_MOST)))
    return _let(-(repeats + changes), joint)


def _found(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """Matches as (start, end, kind, token), in code points; the gaps between them give the positions.

    Positions are summed up within blocks of BLOCK matches, and from block to block, so that a text with very
    many matches isn't copied for each of them.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    given = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern)
    parts = F.zip_with(F.zip_with(whole, F.slice(gaps, F.lit(1), F.size(whole)), lambda m, g: F.struct(F.length(m).alias("m"), F.length(g).alias("g"))), given, lambda p, t: F.struct(p["m"].alias("m"), p["g"].alias("g"), t.alias("t")))
    empty = F.array().cast("array<struct<start:int,end:int,kind:int,token:string>>")
    place = KINDS.index(kind)

    def add(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["g"]
        item = F.struct(begin.alias("start"), (begin + p["m"]).alias("end"), F.lit(place).alias("kind"), p["t"].alias("token"))
        return F.struct((begin + p["m"]).alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))

    def block(rows: Column, before: Column) -> Column:
        start = F.struct(before.alias("at"), empty.alias("out"))
        return F.aggregate(rows, start, add, lambda acc: acc["out"])

    def placed(blocks: Column) -> Column:
        lengths = F.transform(blocks, lambda rows: F.aggregate(rows, F.lit(0), lambda acc, p: acc + p["m"] + p["g"]))
        return _let(lengths, lambda own: F.flatten(F.transform(blocks, lambda rows, i: block(rows, F.aggregate(F.slice(own, F.lit(1), i), F.lit(0), lambda acc, x: acc + x)))))

    # Few texts have a match; the others only pay for looking.
    return F.when(F.rlike(text, F.lit(pattern)), _let(_blocks(parts), placed)).otherwise(empty)


def _blocks(items: Column) -> Column:
    """An array of one item or more as an array of arrays of BLOCK items."""
    return _let(items, lambda rows: F.transform(F.sequence(F.lit(0), ((F.size(rows) - 1) / BLOCK).cast("int")), lambda i: F.slice(rows, i * BLOCK + 1, F.lit(BLOCK))))


def _encoding(token: Column) -> Column:
    """The narrowest alphabet that holds the token; null for plain numbers, and where it mixes + or / with - or _."""
    body = F.rtrim(token, F.lit("="))
    named = F.when(F.rlike(body, F.lit("^[0-9]*$")), F.lit(None).cast("string"))
    for name, alphabet in ALPHABETS.items():
        named = named.when(F.translate(body, alphabet, "") == "", F.lit(name))
    return named


def _scanned(df: DataFrame, text_col: str) -> DataFrame:
    """td_base: base spans by start, then kind; td_more: tokens for the battery with class and bin of -ln p of text, 0 where randomness is rejected."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign = F.filter(_found(text, ASSIGN, "assign", 1), lambda s: F.length(s["token"]) >= LEAST_ASSIGNED)
    base = F.array_sort(F.concat(assign, _found(text, ACCESS, "access"), _found(text, HEX, "hex")))

    alphabets = F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair])

    def named(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.rtrim(s["token"], F.lit("=")).alias("body"), _encoding(s["token"]).alias("code"))

    def tested(s: Column) -> Column:
        cell = F.concat_ws("/", s["code"], F.floor(F.log2(F.length(s["body"]).cast("double"))).cast("string"))
        alphabet = F.element_at(alphabets, s["code"])
        tests = lambda squares: F.when(_minus_log_p(s["body"], alphabet, squares) <= -math.log(RANDOM_LEVEL), _minus_log_text(s["body"], alphabet, squares)).otherwise(F.lit(0.0))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), cell.alias("cell"), F.floor(_let(_squares(s["body"]), tests) * P_STEPS).cast("int").alias("bin"))

    tokens = F.transform(_found(text, TOKEN, "random"), named)
    encoded = F.filter(tokens, lambda s: s["code"].isNotNull())
    return df.withColumn("td_base", base).withColumn("td_more", F.transform(encoded, tested))


def _claimed_from(scanned: DataFrame) -> DataFrame:
    """One row: cell -> least bin from which tokens aren't text, by Benjamini and Hochberg over all tokens of the cell."""
    counts = scanned.select(F.explode("td_more").alias("s")).groupBy(F.col("s.cell").alias("cell"), F.col("s.bin").alias("bin")).count()
    by_p = Window.partitionBy("cell").orderBy(F.col("bin").desc())
    rank, total = F.sum("count").over(by_p), F.sum("count").over(Window.partitionBy("cell"))
    passed = counts.withColumn("ok", F.exp(-F.col("bin") / P_STEPS) <= FDR * rank / total).filter("ok").groupBy("cell").agg(F.min("bin").alias("bin"))
    return passed.agg(F.map_from_entries(F.collect_list(F.struct("cell", "bin"))).alias("least"))


def scan_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The input rows with `secrets`, an array of (start, end, kind) by start, then kind; code points, end exclusive.

    kind is assign, access, hex (the base patterns) or random (the battery's).  A random span that
    touches a base span isn't added.  Null and empty texts have none; an empty table gives an empty
    one; equal rows get equal spans.  An input column named secrets is replaced.  Counting of
    p-values covers all rows; the table of cells is as large as alphabets times length classes.
    """
    keep = [c for c in df.columns if c != "secrets"]
    out, back = aside(df, keep)
    scanned = _scanned(df.select(*out, F.col(text_col).alias("td_text")), "td_text")
    least = _claimed_from(scanned).scalar()
    names = F.array(*[F.lit(k) for k in KINDS])
    limits = scanned.withColumn("td_least", least)
    bare = F.transform("td_base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    claimed = F.filter("td_more", lambda s: s["bin"] >= F.coalesce(F.try_element_at(F.col("td_least"), s["cell"]), F.lit(1 << 30)))

    def apart(rows: Column) -> Column:
        """The tokens of a block that touch no base span."""
        near = F.filter("td_base", lambda b: (b["start"] < F.element_at(rows, -1)["end"]) & (F.element_at(rows, 1)["start"] < b["end"]))
        return _let(near, lambda own: F.filter(rows, lambda s: ~F.exists(own, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))

    kept = _let(claimed, lambda rows: F.when(F.size(rows) > 0, F.flatten(F.transform(_blocks(rows), apart))).otherwise(rows))
    spans = F.array_sort(F.concat(bare, F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    named = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(names, s["kind"] + 1).alias("kind")))
    # In two steps: names that come back mustn't be taken for the helpers.
    return limits.withColumn("td_found", named).select(*back, F.col("td_found").alias("secrets"))


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace every secret of `secrets` by a mark; overlapping spans become one.  Texts without secrets stay as they are."""
    text = F.col(text_col)

    def pieces(rows: Column, before: Column) -> Column:
        """What stands before each secret of a block from where the last one ended, with a mark for the secret."""
        start = F.struct(before.alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(rows, start, add, lambda acc: F.array_join(acc["out"], ""))

    def add(acc: Column, s: Column) -> Column:
        piece = F.when(s["start"] >= acc["at"], F.array(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    def joined(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda rows: F.array_max(F.transform(rows, lambda s: s["end"])))
        last = lambda own, i: F.coalesce(F.array_max(F.slice(own, F.lit(1), i)), F.lit(0))
        return _let(ends, lambda own: F.concat(F.array_join(F.transform(blocks, lambda rows, i: pieces(rows, last(own, i))), ""), F.substr(text, F.array_max(own) + 1)))

    return df.withColumn(text_col, F.when(F.size("secrets") > 0, _let(_blocks(F.col("secrets")), joined)).otherwise(text))


def op1(spark, sf_dir) -> DataFrame:
    """Secrets of every document."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS if k != "random"],
        F.sha2(F.array_join(F.transform(base, label), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("secrets", label), ",").alias("spans"),
        count("random").alias("n_random"),
    )


def stage(spark, docs, sf_dir) -> DataFrame:
    """Replace the secrets of each document by a mark; no document goes."""
    del spark, sf_dir
    return redact(scan_secrets(docs)).select(*named(docs.columns))
