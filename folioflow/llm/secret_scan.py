r"""Secret scans: base patterns plus a battery of randomness tests. DataFrame functions only.

Base patterns are found leftmost and non-overlapping. Besides them, every token of 20 or
more characters in which an encoding can be inferred (hex, base32, lower or upper base36,
base62, base64 or its URL form, letters of one case or of both) is a candidate, unless it overlaps a base span; and so is every
part of 20 or more characters between the token's hyphens, underscores and strokes.

The battery holds a candidate against "its characters are independent and uniform over that
alphabet" by three statistics: chi-squared over cells of the alphabet (kinds of letters, so
that expected counts are not too small), the number of runs above and below the alphabet's
middle, and the lag-1 serial correlation. Their p-values are combined by Fisher's method;
a token that this rejects is not random.

What is not rejected may still be a name, a path or a title, the more so the shorter it
is, as the tests have little power then. So what the tests look at (how often each cell
occurs and which cells follow each other) is also held against ordinary text: the evidence
is the likelihood ratio of the random alphabet to a chain of kinds of letters as in words,
the smaller one of two chains (words and camel case; capitals). An evidence of x arises with a probability of 1 / x at
most where the chain is right, whatever the length, and true secrets gain evidence with
every character. Over the candidates of a document, Benjamini and Hochberg's procedure for
such evidence keeps the expected share of false discoveries under ``fdr``. A document is
a family of its own, so a row is decided without any other row.

The scan walks a text once per pattern: ``\G.*?pattern`` anchors every search where the
last one ended. Tokens keep their characters, so nothing is looked up by its place in a
long text.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import private

#: The base patterns, in the order that breaks ties.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]+"),
)
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: For access and hex the shortest length may stand in the pattern: a run that is too short holds no other match.
FAST = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Parts of a candidate between signs.
PART = r"[A-Za-z0-9+]{20,}={0,2}"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings from the narrowest on: name, pattern of the token, alphabet.
ENCODINGS = (
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    ("lower26", r"^[a-z]+$", LOWER),
    ("upper26", r"^[A-Z]+$", UPPER),
    ("base32", r"^[A-Z2-7]+=*$", UPPER + "234567"),
    ("lower36", r"^[a-z0-9]+$", DIGITS + LOWER),
    ("upper36", r"^[A-Z0-9]+$", DIGITS + UPPER),
    ("both52", r"^[A-Za-z]+$", UPPER + LOWER),
    ("base62", r"^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    ("base64", r"^[A-Za-z0-9+/]+=*$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"^[A-Za-z0-9_-]+=*$", UPPER + LOWER + DIGITS + "-_"),
)
LETTERS_ONLY = ("lower26", "upper26", "both52")
RANDOM_ALPHA = 1e-3
FDR = 1e-2
SPAN = "array<struct<start:int,rank:int,end:int>>"
TOKENS = "array<struct<start:int,rank:int,end:int,token:string>>"
#: Kinds of letters: vowels, frequent, less frequent and rare consonants in lower case, the same in upper case, digits, signs.
KINDS = "vfmrVFMRds"
LETTERS = ("aeiou", "cdhlmnrst", "bfgkpvwy", "jqxz")
CELLS = (*LETTERS, *(x.upper() for x in LETTERS), DIGITS, "+/_-")
#: How ordinary text goes on after a vowel, a consonant, a digit and a sign (to a vowel, a consonant, a digit, a sign).
GOES_ON = ((0.13, 0.80, 0.03, 0.04), (0.50, 0.42, 0.03, 0.05), (0.08, 0.17, 0.68, 0.07), (0.30, 0.52, 0.15, 0.03))
CONSONANTS = (0.75, 0.22, 0.03)
#: The share of capitals after a small letter, a capital, and what is no letter: words and camel case; capitals.
CAPITALS = ((0.12, 0.30, 0.45), (0.50, 0.93, 0.85))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Elements that are folded at once in prefixes().
RUN = 64


def prefixes(values: Column, zero: int, fold: Callable[[Column, Column], Column]) -> Column:
    """The folds of the first 1, 2, ... elements of an array<int>: within short runs one by one, over whole runs by their totals."""
    start, step = F.lit(zero), lambda acc, x: fold(acc, x)

    def over(runs: Column) -> Column:
        totals = F.transform(runs, lambda run: F.aggregate(run, start, step))

        def carried(before: Column) -> Column:
            inside = lambda run, j: F.transform(run, lambda _, i: F.aggregate(F.slice(run, F.lit(1), i + 1), F.get(before, j), step))
            return F.flatten(F.transform(runs, inside))

        return let(totals, lambda totals: let(F.transform(totals, lambda _, i: F.aggregate(F.slice(totals, F.lit(1), i), start, step)), carried))

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda i: F.slice(values, i * RUN + 1, F.lit(RUN)))
    return F.when(F.size(values) > 0, let(runs, over)).otherwise(F.array().cast("array<int>"))


def found(text: Column, pattern: str, rank: int, least: int | None = None, tokens: bool = False) -> Column:
    """The leftmost non-overlapping matches as SPAN, or as TOKENS; least: the fewest characters of group 2."""
    parts = F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?(?:{pattern})"), F.lit(0))
    long = lambda part: F.char_length(F.regexp_extract(part, pattern, 2)) >= least if least else F.lit(True)
    measured = F.transform(parts, lambda part: F.struct(F.char_length(part).alias("n"), F.regexp_extract(part, pattern, 0).alias("token"), long(part).alias("long")))

    def placed(measured: Column) -> Column:
        ends = prefixes(F.transform(measured, lambda m: m["n"]), 0, lambda acc, n: acc + n)
        spans = F.zip_with(measured, ends, lambda m, end: F.struct((end - F.char_length(m["token"])).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), m["token"].alias("token"), m["long"].alias("long")))
        spans = F.filter(spans, lambda x: x["long"]) if least else spans
        return F.transform(spans, lambda x: F.struct(x["start"], x["rank"], x["end"], *([x["token"]] if tokens else [])))

    return F.when(F.size(parts) > 0, let(measured, placed)).otherwise(F.array().cast(TOKENS if tokens else SPAN))


def free(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no base span: none before them reaches into them, and the next one begins after them."""
    rows = F.array_sort(F.concat(F.transform(base, lambda b: F.struct(b["start"], b["rank"], b["end"], F.lit("").alias("token"))), tokens))
    is_token, last = lambda x: x["rank"] == len(BASE), 2**31 - 1

    def kept(rows: Column) -> Column:
        reach = prefixes(F.transform(rows, lambda x: F.when(is_token(x), 0).otherwise(x["end"])), 0, F.greatest)
        following = F.reverse(prefixes(F.reverse(F.transform(rows, lambda x: F.when(is_token(x), last).otherwise(x["start"]))), last, F.least))
        bounds = F.zip_with(reach, following, lambda r, f: F.struct(r.alias("reach"), f.alias("next")))
        marked = F.zip_with(rows, bounds, lambda x, b: F.struct(x.alias("x"), (is_token(x) & (b["reach"] <= x["start"]) & (b["next"] >= x["end"])).alias("free")))
        return F.transform(F.filter(marked, lambda m: m["free"]), lambda m: m["x"])

    return F.when((F.size(tokens) > 0) & (F.size(base) > 0), let(rows, kept)).otherwise(tokens)


def with_parts(tokens: Column) -> Column:
    """The tokens, each followed by its parts."""

    def parts(t: Column) -> Column:
        inner = F.transform(found(t["token"], PART, len(BASE), tokens=True), lambda x: F.struct((t["start"] + x["start"]).alias("start"), x["rank"], (t["start"] + x["end"]).alias("end"), x["token"]))
        own = F.filter(inner, lambda x: F.char_length(x["token"]) < F.char_length(t["token"]))
        return F.when(t["token"].rlike("[-_/]"), F.concat(F.array(t), own)).otherwise(F.array(t))

    return let(tokens, lambda tokens: F.when(F.exists(tokens, lambda t: t["token"].rlike("[-_/]")), F.flatten(F.transform(tokens, parts))).otherwise(tokens))


def outermost(spans: Column) -> Column:
    """Spans (sorted by start, the longest first) without those that lie within one that begins earlier."""

    def kept(spans: Column) -> Column:
        reach = prefixes(F.transform(spans, lambda x: x["end"]), 0, F.greatest)
        return let(reach, lambda reach: F.filter(spans, lambda x, i: (i == 0) | (x["start"] >= F.get(reach, i - 1))))

    return let(spans, lambda spans: F.when(F.size(spans) > 1, kept(spans)).otherwise(spans))


def survival(z: Column) -> Column:
    """P(Z > z) of a normal variable, by the logistic approximation of Bowling and others (error below 2e-4)."""
    return 1 / (1 + F.exp(F.lit(0.07056) * z * z * z + F.lit(1.5976) * z))


def inferred(token: Column) -> Column:
    """The place in ENCODINGS of the narrowest encoding that fits; null where none does: it takes a letter of each case that the encoding mixes, and a digit unless it has letters only."""
    digit, letter = token.rlike("[0-9]"), token.rlike("[A-Za-z]")
    both = token.rlike("[A-Z]") & token.rlike("[a-z]")
    out = F.lit(None).cast("int")
    for k, (name, pattern, _) in reversed(list(enumerate(ENCODINGS))):
        cases = both if name.startswith(("base6", "both")) else letter
        mixed = cases if name in LETTERS_ONLY else digit & cases
        out = F.when(token.rlike(pattern), F.when(mixed, F.lit(k))).otherwise(out)
    return out


def shares(alphabet: str) -> list[float]:
    """The share of each kind in an alphabet."""
    return [sum(c in cell for c in alphabet) / len(alphabet) for cell in CELLS]


def text_chain(alphabet: str, capitals: tuple[float, float, float]) -> list[list[float]]:
    """The probabilities of the next kind after each kind in ordinary text, among the kinds that the alphabet has."""
    has = [x > 0 for x in shares(alphabet)]
    of = [0, 1, 1, 1, 0, 1, 1, 1, 2, 3]  # vowel, consonant, digit, sign
    within = [1.0, *CONSONANTS, 1.0, *CONSONANTS, 1.0, 1.0]
    out = []
    for before in range(len(KINDS)):
        upper = capitals[0 if before < 4 else 1 if before < 8 else 2]
        case = [1 - upper] * 4 + [upper] * 4 if any(has[:4]) and any(has[4:8]) else [1.0] * 8
        row = [GOES_ON[of[before]][of[k]] * within[k] * [*case, 1.0, 1.0][k] * has[k] for k in range(len(KINDS))]
        out.append([x / sum(row) for x in row])
    return out


def evidence_table(capitals: tuple[float, float, float]) -> list[float]:
    """log(random / text) at [encoding][kind before][kind]; 0 for kinds that the encoding does not have."""
    out = []
    for _, _, alphabet in ENCODINGS:
        random = shares(alphabet)
        out += [math.log(random[k] / p) if random[k] else 0.0 for row in text_chain(alphabet, capitals) for k, p in enumerate(row)]
    return out


def prepared(token: Column, code: Column, span: Column) -> Column:
    """What battery() reads of a token under ENCODINGS[code]: its span, its characters' places in the alphabet and kinds, and how often each kind occurs."""
    body = F.when(code == 0, F.lower(token)).otherwise(F.rtrim(token, F.lit("=")))

    def parts(body: Column) -> Column:
        alphabet = F.get(F.lit([a for _, _, a in ENCODINGS]), code)
        kinds = F.translate(body, "".join(CELLS), "".join(k * len(cell) for k, cell in zip(KINDS, CELLS, strict=True)))
        place = lambda c: F.instr(alphabet, c).cast("double") - (F.char_length(alphabet) + 1) / F.lit(2.0)
        letters = F.zip_with(F.split(body, ""), F.split(kinds, ""), lambda c, k: F.struct(place(c).alias("y"), (F.instr(F.lit(KINDS), k) - 1).alias("kind")))
        return F.struct(span.alias("span"), code.alias("code"), letters.alias("letters"))

    def counted(t: Column) -> Column:
        of = lambda k: F.size(F.filter(t["letters"], lambda x: x["kind"] == k)).cast("double")
        seen = F.array(*[of(k) for k in range(len(KINDS))])
        return F.struct(t["span"].alias("span"), t["code"].alias("code"), t["letters"].alias("letters"), seen.alias("seen"), F.size(t["letters"]).cast("double").alias("n"))

    return let(let(body, parts), counted)


def battery(t: Column) -> Column:
    """struct<p, evidence> of a prepared token: Fisher's combination of the three tests' p-values, and the log of the evidence against ordinary text."""
    width, n = len(KINDS), t["n"]
    share = F.get(F.lit([shares(a) for _, _, a in ENCODINGS]), t["code"])
    degrees = F.get(F.lit([float(sum(x > 0 for x in shares(a)) - 1) for _, _, a in ENCODINGS]), t["code"])
    chi = F.aggregate(F.zip_with(t["seen"], share, lambda seen, q: F.when(q > 0, F.pow(seen - n * q, F.lit(2.0)) / (n * q)).otherwise(0.0)), F.lit(0.0), lambda acc, x: acc + x)
    tables = [F.lit(evidence_table(c)) for c in CAPITALS]
    start = F.struct(F.lit(0.0).alias("runs"), F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("last"), (t["code"] * width * width + (width - 1) * width).alias("row"), F.lit(0.0).alias("words"), F.lit(0.0).alias("capitals"))

    def step(acc: Column, x: Column) -> Column:
        here = acc["row"] + x["kind"]
        return F.struct(
            (acc["runs"] + F.when(acc["last"] * x["y"] <= 0, 1.0).otherwise(0.0)).alias("runs"),
            (acc["xy"] + acc["last"] * x["y"]).alias("xy"),
            (acc["xx"] + x["y"] * x["y"]).alias("xx"),
            x["y"].alias("last"),
            (t["code"] * width * width + x["kind"] * width).alias("row"),
            (acc["words"] + F.get(tables[0], here)).alias("words"),
            (acc["capitals"] + F.get(tables[1], here)).alias("capitals"),
        )

    def combined(moved: Column) -> Column:
        spread = F.lit(2.0) / (9 * degrees)
        cells = (F.cbrt(chi / degrees) - (1 - spread)) / F.sqrt(spread)  # a normal variable (Wilson and Hilferty)
        runs = F.abs(moved["runs"] - ((n - 1) / 2 + 1)) / F.sqrt((n - 1) / 4)
        serial = F.abs(moved["xy"] / moved["xx"]) * F.sqrt(n)
        p = F.array(*[F.greatest(q, F.lit(1e-12)) for q in (survival(cells), 2 * survival(runs), 2 * survival(serial))])
        evidence = F.least(moved["words"], moved["capitals"])
        logs = F.transform(p, lambda q: F.log(q))
        half = -F.aggregate(logs, F.lit(0.0), lambda acc, x: acc + x)
        # the upper tail of chi-squared with 6 degrees of freedom
        tail = let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))
        return F.struct(tail.alias("p"), evidence.alias("evidence"))

    return F.aggregate(t["letters"], start, step, combined)


def scanned(rows: DataFrame, text: Column, names: dict[str, str], alpha: float, fdr: float) -> DataFrame:
    """rows with the columns assign, access, hex, base and extra (under their names in ``names``); what else ``names`` has is dropped again."""
    n = names
    rows = rows.withColumns({
        n["assign"]: found(text, BASE[0][1], 0, LEAST["assign"]),
        n["access"]: found(text, FAST["access"], 1),
        n["hex"]: found(text, FAST["hex"], 2),
        n["tokens"]: found(text, CANDIDATE, len(BASE), tokens=True),
    })
    rows = rows.withColumn(n["base"], F.array_sort(F.concat(n["assign"], n["access"], n["hex"])))
    rows = rows.withColumn(n["tokens"], with_parts(free(F.col(n["tokens"]), F.col(n["base"]))))
    coded = F.transform(n["tokens"], lambda t: F.struct(F.struct(t["start"], t["rank"], t["end"]).alias("span"), t["token"].alias("token"), inferred(t["token"]).alias("code")))
    rows = rows.withColumn(n["tokens"], F.when(F.size(n["tokens"]) > 0, F.filter(coded, lambda t: t["code"].isNotNull())))
    rows = rows.withColumn(n["tokens"], F.transform(n["tokens"], lambda t: prepared(t["token"], t["code"], t["span"])))
    rows = rows.withColumn(n["tokens"], F.transform(n["tokens"], lambda t: F.struct(t["span"].alias("span"), battery(t).alias("b"))))
    # what is not random has no evidence, but still counts as a candidate of the family
    family = F.array_sort(F.transform(n["tokens"], lambda t: F.struct((-F.when(t["b"]["p"] >= alpha, t["b"]["evidence"]).otherwise(F.lit(-1e300))).alias("against"), t["span"].alias("span"))))
    rows = rows.withColumn(n["tokens"], family)
    size = F.size(n["tokens"])
    passed = F.transform(n["tokens"], lambda t, i: F.when(-t["against"] >= F.log(size / ((i + 1) * F.lit(fdr))), i + 1).otherwise(0))
    extra = F.transform(F.slice(n["tokens"], F.lit(1), F.coalesce(F.array_max(passed), F.lit(0))), lambda t: t["span"])
    return rows.withColumn(n["extra"], F.coalesce(outermost(F.array_sort(extra, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))), F.array().cast(SPAN))).drop(n["tokens"])


MADE = ("assign", "access", "hex", "base", "extra", "tokens")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = RANDOM_ALPHA, fdr: float = FDR) -> DataFrame:
    """One row per input row: doc_id, text, and assign, access, hex, base and extra (arrays of start, rank, end).

    A null or empty text has no spans. Rows are independent: repeated rows and null ids
    need no rule, an empty table gives no rows. rank is a place in BASE; extra spans have
    the next one, and none overlaps a base span. Other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return scanned(rows, F.col("text"), {name: name for name in MADE}, alpha, fdr)


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(kind) for kind, _ in BASE], F.lit("random"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def merged(spans: Column) -> Column:
    """Sorted spans as array<struct<start, end>> in which none overlaps another; spans that touch stay apart."""

    def joined(spans: Column, reach: Column) -> Column:
        fresh = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.get(reach, i - 1)))
        end = lambda fresh, k: F.get(reach, F.coalesce(F.get(fresh, k + 1), F.size(spans)) - 1)
        return let(fresh, lambda fresh: F.transform(fresh, lambda i, k: F.struct(F.get(spans, i)["start"].alias("start"), end(fresh, k).alias("end"))))

    whole = let(spans, lambda spans: let(prefixes(F.transform(spans, lambda x: x["end"]), 0, F.greatest), lambda reach: joined(spans, reach)))
    return F.when(F.size(spans) > 0, whole).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


#: Code points of the pieces in which a text is redacted, so that a place is found by walking one piece.
PIECE = 4096


def redacted(text: Column, spans: Column, mark: str = "<SECRET>") -> Column:
    """text with every span (sorted; they may overlap) replaced by the mark."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))

    def rewritten(piece: Column, i: Column, spans: Column) -> Column:
        low = i * PIECE
        own = F.filter(spans, lambda s: (s["end"] > low) & (s["start"] < low + PIECE))
        begun = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

        def step(acc: Column, s: Column) -> Column:
            start = F.greatest(s["start"] - low, F.lit(0))
            out = F.concat(acc["out"], F.substring(piece, acc["at"] + 1, start - acc["at"]), F.when(s["start"] >= low, F.lit(mark)).otherwise(F.lit("")))
            return F.struct(out.alias("out"), (s["end"] - low).alias("at"))

        return F.when(F.size(own) > 0, F.aggregate(own, begun, step, lambda acc: F.concat(acc["out"], F.substring(piece, acc["at"] + 1, F.lit(PIECE))))).otherwise(piece)

    whole = let(merged(spans), lambda spans: F.array_join(F.transform(pieces, lambda piece, i: rewritten(piece, i, spans)), ""))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame, alpha: float = RANDOM_ALPHA, fdr: float = FDR) -> DataFrame:
    """docs with secrets replaced in ``text`` and n_chars counted anew; a null text stays null, rows and other columns stay as they are, whatever their names."""
    names = private(docs.columns, *MADE)
    rows = scanned(docs, F.coalesce("text", F.lit("")), names, alpha, fdr)
    out = rows.withColumn("text", F.when(F.col("text").isNotNull(), redacted(F.col("text"), F.array_sort(F.concat(names["base"], names["extra"])))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
