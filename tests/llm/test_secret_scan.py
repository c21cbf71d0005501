from __future__ import annotations

import math
import random
import re
import string
import time

from pyspark.sql import functions as F

from folioflow.llm import secret_scan as s

from llm_data import documents, odd_texts, prose

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text: str | None) -> list[tuple[int, int, int]]:
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def rows(spark, texts):
    return {r["doc_id"]: r for r in s.scan(documents(spark, texts)).collect()}


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(6)
    bits = ["password", "PassWd", "secret", "token", "api_key", "apikey", "ſecret", ":", "=", " ", " ", "'", '"', "abc", "abcdef", "deadbeef" * 3, "a1" * 11, "AKIA" + "A" * 16, "AKIA" + "Z9" * 7, "AKIA", "é", "😀", "\n", "==", "x.y-z"]
    texts = odd_texts() + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    got = rows(spark, texts)
    for i, text in enumerate(texts):
        assert [tuple(x) for x in got[i]["base"]] == brute(text), text
        assert [got[i][k] is not None for k in ("assign", "access", "hex")] == [True] * 3


def test_random_tokens_are_found_and_words_are_not(spark):
    rng = random.Random(7)
    alphabets = [string.ascii_letters + string.digits, string.ascii_uppercase + "234567", string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits]
    texts = [f"see {''.join(rng.choice(rng.choice(alphabets[:1]) if False else alphabets[i % 4]) for _ in range(rng.randint(28, 64)))} there" for i in range(200)]
    got = rows(spark, texts)
    assert sum(len(r["extra"]) + len(r["base"]) > 0 for r in got.values()) >= 190
    words = [prose(rng, 200) for _ in range(30)] + ["com/fr/825/some/long/title/of/an/article", "version-2021-final-draft-of-the-report-12", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa1111111111Bb", "2024-01-01T00-00-00Z-logfile-export-3", "user_profile_settings_page_v2_final", "internationalization2024localization"]
    assert all(not r["extra"] for r in rows(spark, words).values())


def random_like(token: str, code: int) -> tuple[float, float]:
    """p of the battery and the evidence of a token, one character after another."""
    alphabet = s.ENCODINGS[code][2]
    body = token.lower() if code == 0 else token.rstrip("=")
    n, size = len(body), len(alphabet)
    upper = lambda z: 1 / (1 + math.exp(min(700.0, 0.07056 * z**3 + 1.5976 * z)))
    kind = [next(k for k, cell in enumerate(s.CELLS) if c in cell) for c in body]
    share = [sum(c in cell for c in alphabet) / size for cell in s.CELLS]
    there = [k for k in range(10) if share[k]]
    chi, df = sum((kind.count(k) - n * share[k]) ** 2 / (n * share[k]) for k in there), len(there) - 1
    y = [alphabet.index(c) + 1 - (size + 1) / 2 for c in body]
    runs = 1 + sum(a * b <= 0 for a, b in zip(y, y[1:]))
    serial = sum(a * b for a, b in zip(y, y[1:])) / sum(a * a for a in y)
    p = [upper(((chi / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df))), 2 * upper(abs(runs - (n + 1) / 2) / math.sqrt((n - 1) / 4)), 2 * upper(abs(serial) * math.sqrt(n))]
    half = -sum(math.log(max(x, 1e-12)) for x in p)
    evidence = []
    for capitals in s.CAPITALS:
        chain, before, total = s.text_chain(alphabet, capitals), 9, 0.0
        for k in kind:
            total += math.log(share[k] / chain[before][k])
            before = k
        evidence.append(total)
    return math.exp(-half) * (1 + half + half * half / 2), min(evidence)


def brute_extra(text: str | None) -> list[tuple[int, int, int]]:
    text, base, family = text or "", brute(text), []
    for m in re.finditer(s.CANDIDATE, text):
        token = m[0]
        if any(b < m.end() and m.start() < e for b, _, e in base):
            continue
        parts = [(m.start(), token)]
        if re.search("[-_/]", token):
            parts += [(m.start() + x.start(), x[0]) for x in re.finditer(s.PART, token) if len(x[0]) < len(token)]
        for start, part in parts:
            code = next((k for k, (_, pattern, _) in enumerate(s.ENCODINGS) if re.search(pattern, part)), None)
            name = "" if code is None else s.ENCODINGS[code][0]
            cases = re.search("[A-Z]", part) and re.search("[a-z]", part) if name.startswith(("base6", "both")) else re.search("[A-Za-z]", part)
            if code is not None and cases and (name in s.LETTERS_ONLY or re.search("[0-9]", part)):
                p, evidence = random_like(part, code)
                family.append((evidence if p >= s.RANDOM_ALPHA else -1e300, start, start + len(part)))
    family.sort(key=lambda f: (-f[0], f[1]))
    k = max((i for i, f in enumerate(family, 1) if f[0] >= math.log(len(family) / (i * s.FDR))), default=0)
    out: list[tuple[int, int, int]] = []
    for _, a, b in sorted(family[:k], key=lambda f: (f[1], -f[2])):
        if not out or a >= out[-1][2]:
            out.append((a, 3, b))
    return out


#: Our own: names, titles, paths and numbers as they stand in code and on pages.
IDENTIFIERS = """BackgroundImage2xRetinaDisplay Chapter12TheHouseOnTheHill MyDocuments2019FinalVersionA IPhone15ProMaxReviewAndSpecs
    getElementsByClassName2024 QuarterlyReport2023FinalV2Draft MAX_RETRY_COUNT_PER_HOST_2 HTTP2ServerConnectionPoolManager user_profile_settings_page_v2
    version2021finaldraftreport12 2024-Annual-Report-Executive-Summary Windows10EnterpriseEditionSetup openglextension3dtexturecompression UTF8StringDecoderWithFallback2
    Bundesgesetzblatt2021TeilISeite3436 com/google/android/apps/Photos2024 IMG20240131WA0005Edited1 INVOICE2024000123456COPY 20240131T101530Z20240201T000000Z
    ORDER123456789012345678X LesMiserablesTome2LivrePremier AReallyLongClassNameWithNumber7InIt SELECT1FROMTABLEWHEREID2 PKCS12KeyStoreLoaderFactory Nightly20240131Build4Release""".split()


def test_extra_spans_equal_brute_force(spark):
    rng = random.Random(8)
    letters = [string.ascii_letters + string.digits, string.ascii_uppercase + "234567", string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.hexdigits.upper(), string.ascii_letters + string.digits + "-_"]
    token = lambda: "".join(rng.choice(rng.choice(letters[:1]) if rng.random() < 0.1 else alphabet) for alphabet in [rng.choice(letters)] for _ in range(rng.randint(18, 40)))
    texts = odd_texts() + [" ".join(rng.choice([token(), rng.choice(IDENTIFIERS), prose(rng, 3), "token=" + token(), token() + "==", "0123456789abcdef" * 2]) for _ in range(rng.randint(1, 12))) for _ in range(200)]
    got = rows(spark, texts)
    for i, text in enumerate(texts):
        assert [tuple(x) for x in got[i]["extra"]] == brute_extra(text), text
    assert sum(len(r["extra"]) for r in got.values()) > 100


def test_precision_and_recall_on_labelled_tokens(spark):
    rng = random.Random(9)
    alphabet = string.ascii_letters + string.digits
    names = rows(spark, [f"see {x} there" for x in IDENTIFIERS])
    assert sum(len(r["extra"]) for r in names.values()) == 0
    for n, least in ((20, 0.88), (24, 0.93), (32, 0.95)):
        got = rows(spark, [f"see {''.join(rng.choice(alphabet) for _ in range(n))} there" for _ in range(200)])
        assert sum(len(r["extra"]) for r in got.values()) >= least * 200


#: Our own: names and phrases without a digit, as they stand in code, addresses and prose.
PLAIN_NAMES = """AbstractSingletonProxyFactoryBean internationalizationandlocalization getElementsByClassNameAndTagName MAXIMUMALLOWABLECONCENTRATION ThisIsTheWayWeWashOurClothes donaudampfschifffahrtsgesellschaft
    onceuponatimeinafarawayland org/springframework/context/annotation how-to-write-better-commit-messages SOME_VERY_LONG_CONSTANT_NAME_HERE honorificabilitudinitatibus pseudopseudohypoparathyroidism
    KeyboardInterruptExceptionHandler LookAtThatBeautifulSunsetTonight electroencephalographically thequickbrownfoxjumpsoverthelazydog WAREHOUSEMANAGEMENTSYSTEM backgroundColorTransitionDuration
    constantinopolitanischerdudelsack rechtsschutzversicherungsgesellschaften loremipsumdolorsitametconsectetur adipiscingelitseddoeiusmod""".split()


def test_recall_by_kind_of_token(spark):
    """Of 150 each: tokens with a prefix and parts, letters only, and the usual ones."""
    rng = random.Random(19)
    of = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    letters, digits = string.ascii_letters, string.digits
    kinds = {
        "xoxb": (lambda: f"xoxb-{of(digits, 12)}-{of(digits, 13)}-{of(letters + digits, 24)}", 0.9),
        "prefixed": (lambda: f"ghp_{of(letters + digits, 36)}", 0.97),
        "letters": (lambda: of(letters, 32), 0.9),
        "long letters": (lambda: of(letters, 48), 0.97),
        "lower": (lambda: of(string.ascii_lowercase, 40), 0.85),
        "upper": (lambda: of(string.ascii_uppercase, 40), 0.85),
        "path": (lambda: f"v1/keys/{of(letters + digits, 40)}", 0.97),
        "base62": (lambda: of(letters + digits, 24), 0.93),
    }
    names = [(kind, make()) for kind, (make, _) in kinds.items() for _ in range(150)]
    got = rows(spark, [f"see {t} there" for _, t in names])
    share = {k: sum(len(got[i]["extra"]) > 0 for i, (kind, _) in enumerate(names) if kind == k) / 150 for k in kinds}
    assert all(share[k] >= least for k, (_, least) in kinds.items()), share
    plain = rows(spark, [f"see {x} there" for x in PLAIN_NAMES])
    assert [PLAIN_NAMES[i] for i, r in plain.items() if r["extra"]] == []


def test_time_is_linear_in_the_spans_of_a_text(spark):
    rng = random.Random(10)
    alphabet = string.ascii_letters + string.digits

    def seconds(n: int) -> float:
        tokens = ("".join(rng.choice(alphabet) for _ in range(30)) for _ in range(n))
        df = documents(spark, [" ".join(f"token={t[:12]}" if i % 2 else t for i, t in enumerate(tokens))]).cache()
        df.count()
        begun = time.time()
        s.redact(df).write.format("noop").mode("overwrite").save()
        return time.time() - begun

    seconds(2000)
    assert seconds(16_000) < 4 * max(seconds(4000), 1)


def test_extra_spans_do_not_overlap_base_spans(spark):
    texts = [f"token = {'0123456789abcdef' * 3} and {'q8Zr5Yt1LmW0xKs7Vb3NhJd9'}"]
    r = rows(spark, texts)[0]
    assert [x["rank"] for x in r["base"]] == [0, 2] and len(r["extra"]) == 1
    assert spark.createDataFrame([(0,)], "i int").select(s.written(F.lit(None).cast(s.SPAN))).first()[0] in (None, "")
    df = s.scan(documents(spark, texts))
    assert df.select(s.written(F.col("base"))).first()[0] == "assign:0:56,hex:8:56"


def test_redaction(spark):
    key = "AKIA" + "B" * 16
    texts = [f"é {key} and password: hunter22x!", None, "", "plain text", f"{key}{key}"]
    df = documents(spark, texts)
    out = s.redact(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got[0] == ("é <SECRET> and <SECRET>!", 24)
    assert got[1] == (None, None) and got[2] == ("", 0) and got[3][0] == "plain text" and got[4][0] == "<SECRET>"
    assert s.redact(documents(spark, [])).count() == 0


def test_columns_of_any_name_stay(spark):
    columns = ["base", "assign", "access", "hex", "extra", "tokens", "was_null", "__base", "__Hex", "doc_id", "n_chars"]
    df = spark.createDataFrame([tuple([f"AKIA{'B' * 16}"] + [f"keep {c}" for c in columns[:-2]] + [1, 5])], ["text", *columns])
    out = s.redact(df)
    assert out.columns == df.columns
    assert tuple(out.first()) == ("<SECRET>", *[f"keep {c}" for c in columns[:-2]], 1, 8)


def test_only_built_in_functions_run(spark):
    plan = s.scan(documents(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
