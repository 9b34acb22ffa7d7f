"""Secret scans with DataFrame operations only: a random forest removes false positives.

Candidates are runs of 16 or more key characters anywhere in a text, and shorter values of 4 or more characters of any
kind that stand after an assignment or a secret word. Each one's length, character transitions,
dictionary coverage, path and neighbouring words become numbers by built-in functions; a forest that is trained on the
driver from labelled findings becomes one CASE expression. Candidates stay in an array beside their text, so a scan is
one narrow pass without shuffles, and redaction joins the pieces between the candidates again.

The dictionary is the corpus's own: its DICTIONARY most frequent words, counted over all documents. Labelled findings are
given as a list or a table of (c, l, r, p, y): candidate, text to its left and right, path, 1 for a secret. Without any,
a list of the kinds that scanners report is made (``labelled_findings``). The features of both come from the same
expressions. At most FINDINGS labelled findings are fitted, those with the least hash.

Defined results: a null or empty text has no candidates; rows that repeat give findings that repeat; a null id is
carried; other columns are ignored (``redact`` keeps them, whatever their names); an empty table gives no rows.
"""

from __future__ import annotations

import base64
import random
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LEAST_CHARS = 16
_CHARS = r"A-Za-z0-9+/_~.=\-"
_LONG = f"[{_CHARS}]{{{LEAST_CHARS},}}"
_QUOTE, _QUOTED, _BARE, _REST = r"[\"'`]", r"[^\s\"'`]", r"[^\s\"'`,;<>(){}\[\]=:]", r"[^\s\"'`,;<>(){}\[\]]"
#: What stands before a short value: = or :, or a word for secrets.
_HEAD = r"(?:[=:]\s{0,2}|(?i:pass(?:word|wd|phrase)|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credentials?)(?: is)? )"
_NOT_LONG = f"(?!{_QUOTED}*?{_LONG})"
#: Values without a long run; a value in quotes ends with them. Few places start with one of the first letters.
_SHORT = f"(?=[=:aAbBcCpPsStT]){_HEAD}(?:{_QUOTE}{_NOT_LONG}{_QUOTED}{{4,}}+|{_NOT_LONG}{_BARE}{_REST}{{3,}}+)"
CANDIDATE = f"(?<![{_CHARS}]){_LONG}+|{_SHORT}"
LEFT_CHARS, RIGHT_CHARS = 48, 24
#: Words of the dictionary, their least and most letters; labelled findings that a fit takes.
DICTIONARY, WORD_CHARS, FINDINGS = 2000, (4, 14), 20_000
#: Forest: trees, depth, least findings in a leaf; a finding is a secret from this score on.
TREES, DEPTH, LEAF, CUT = 15, 6, 4, 0.5
SECRET = "[SECRET]"

FEATURES = ("length", "digits", "upper", "classes", "distinct", "vowels", "clusters", "dictionary", "hex", "numeric", "uuid", "assigned", "secret_word", "near_word", "benign_word", "placeholder", "path", "slashes", "prefix", "symbols")


def _share(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)) / F.length(c)


def _flag(c: Column) -> Column:
    return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))


_SECRET_WORD = r"(token|secret|passw|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private)"


def dictionary(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> list[str]:
    """The most frequent words of all texts, in lower case, ASCII letters only; ``size`` of them at most."""
    low, high = WORD_CHARS
    words = docs.select(F.explode(F.split(F.lower(text_col), "[^a-z]+")).alias("w")).where(F.length("w").between(low, high))
    return [r["w"] for r in words.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "w").limit(size).collect()]


def pattern_of(words: list[str]) -> str:
    """A pattern of any of the words, the longest that fits; words with a common beginning share it."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def text(node: dict) -> str:
        more = [c + text(n) for c, n in sorted(node.items()) if c]
        if not more:
            return ""
        return (more[0] if len(more) == 1 and "" not in node else f"(?:{'|'.join(more)})") + ("?" if "" in node else "")

    return text(tree) or "(?!)"


def features(x: Column, words: str) -> Column:
    """A struct of doubles for a candidate x: c (itself), l and r (text to its left and right), p (path). words: the
    dictionary's pattern."""
    c, left, right, path = x["c"], F.right(x["l"], F.lit(LEFT_CHARS)), F.left(x["r"], F.lit(RIGHT_CHARS)), F.lower(F.coalesce(x["p"], F.lit("")))
    low, near = F.lower(c), F.lower(F.concat(left, F.lit(" "), right))
    values = (
        F.length(c).cast("double"),
        _share(c, "[0-9]"),
        _share(c, "[A-Z]"),
        _share(c, "(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]"),
        F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
        _share(low, "[aeiouy](?=[bcdfghjklmnpqrstvwxz])"),
        _share(low, "[bcdfghjklmnpqrstvwxz]{4}"),
        F.lit(1.0) - F.length(F.regexp_replace(low, words, "")) / F.length(c),
        _flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        _flag(c.rlike(r"^[0-9._=+/\-]+$")),
        _flag(c.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")),
        _flag(left.rlike("[=:]\\s*[\"'`]?$")),
        _flag(F.lower(left).rlike(_SECRET_WORD)),
        _flag(F.lower(F.right(left, F.lit(20))).rlike(_SECRET_WORD)),
        _flag(near.rlike(r"(sha-?1|sha-?256|sha-?512|md5|commit|checksum|digest|hash|integrity|etag|uuid|guid|revision|https?:|href|src=|www|mailto|@)")),
        _flag(low.rlike("(example|sample|dummy|placeholder|change|your|xxxx|todo|test|fake|1234567|abcdef|00000|aaaaa)")),
        _flag(path.rlike("(test|spec|fixture|example|docs?/|sample|mock|vendor|lock)")),
        _share(c, "[/.]"),
        _flag(c.rlike(r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk_live_|rk_live_|xox[abprs]-|AIza|eyJ|npm_|pypi-)")),
        _share(c, "[^A-Za-z0-9]"),
    )
    return F.struct(*[v.cast("double").alias(n) for n, v in zip(FEATURES, values, strict=True)])


def labelled_findings(words: list[str] = (), n: int = 3000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(candidate, left, right, path, 1 for a secret): the kinds that scanners report, half of them false positives, in
    the given words; without any in made-up ones."""
    r = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    syllables = [a + b for a in ("th", "er", "st", "n", "r", "l", "sch", "ch", "m", "p", "qu", "v", "t") for b in ("a", "e", "i", "on", "en", "ou", "eau", "an", "ing", "ion")]
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda a, b: _made(r, words, syllables, a, b)
    prose = lambda: " ".join(word(1, 3) for _ in range(r.randint(2, 6)))
    b64 = lambda k: base64.b64encode(r.randbytes(k)).decode()
    hexa = lambda: pick("0123456789abcdef", r.choice((32, 40, 64)))
    secret_left = ('token = "', "api_key: ", 'SECRET_KEY="', "password=", "Authorization: Bearer ", "aws_secret_access_key = ", 'client_secret": "', "auth_token='", "PRIVATE KEY ", "access_key=", "passwd: ", 'apikey = "')
    paths = ("", "src0", "src7", "src/app/config.py", ".env", "web", "deploy/prod.yml", "notes")
    out = []
    while len(out) < n:
        path, left, right = r.choice(paths), prose() + " ", r.choice(('" ', '"', "' ", " ", "\n", "")) + prose()
        if len(out) % 2:
            kind = r.randrange(6)
            if kind == 0:
                c = hexa()
            elif kind == 1:
                c = b64(r.randint(18, 48))
            elif kind == 2:
                c = pick(lower + upper + digits, r.randint(20, 48))
            elif kind == 3:
                c = r.choice(("AKIA" + pick(upper + digits, 16), "ghp_" + pick(lower + upper + digits, 36), "glpat-" + pick(lower + upper + digits, 20), "sk_live_" + pick(lower + upper + digits, 24)))
            elif kind == 4:
                c = r.choice(("xoxb-" + pick(digits, 12) + "-" + pick(lower + upper + digits, 24), "eyJ" + pick(lower + upper + digits, 30) + "." + pick(lower + upper + digits, 40), "AIza" + pick(lower + upper + digits + "_-", 35)))
            else:
                c = pick(lower + digits, r.randint(20, 40))
            if kind not in (3, 4) or r.random() < 0.5:
                left += r.choice(secret_left)
            out.append((c, left[-LEFT_CHARS:], right[:RIGHT_CHARS], path, 1))
            continue
        kind = r.randrange(10)
        if kind <= 2:
            c = (word(6, 10) + word(1, 2))[: r.randint(16, 30)].ljust(16, "e")
            c = (c.capitalize() if r.random() < 0.2 else c.upper() if r.random() < 0.1 else c) + r.choice(("", "", ".", ".."))
        elif kind == 3:
            c, left = hexa(), left + r.choice(("commit ", "revision: ", 'checksum = "', "sha256:", "md5 = ", "digest: ", "etag: ", 'hash="', "git hash "))
        elif kind == 4:
            c, left = str(uuid.UUID(bytes=r.randbytes(16))), left + r.choice(("", "id: ", 'uuid = "', "guid=", "request_id="))
        elif kind == 5:
            c = r.choice(("your-api-token-here", "xxxxxxxxxxxxxxxxxxxx", "EXAMPLE-TOKEN-0000", "changeme-changeme-1", "insert_your_secret_here", "0123456789abcdef0123456789abcdef", "placeholder_value_1234", "aaaaaaaaaaaaaaaaaaaaaaaa", "test_token_test_token"))
            left += r.choice(secret_left)
        elif kind == 6:
            c = r.choice((pick(digits, 16), pick(digits, r.randint(16, 20)), f"20{pick(digits, 2)}-{pick(digits, 2)}-{pick(digits, 2)}-{pick(digits, 6)}", "-".join(pick(digits, 4) for _ in range(4)), "=" * r.randint(16, 40), "-" * r.randint(16, 40), "." * 20))
            left += r.choice(("", "", "card ", "number: ", "phone "))
        elif kind == 7:
            c = r.choice((f"mail{r.randint(1, 9)}.example.com", f"www.{word(2, 4)}.example.org", "/usr/local/lib/" + word(2, 4), "/".join(word(1, 3) for _ in range(5)) + "/index.html"))
            left += r.choice(("", word(1, 2) + ".19@", "https:", 'href="'))
        elif kind == 8:
            c = "_".join(word(1, 3) for _ in range(4)) if r.random() < 0.5 else "".join(word(1, 3).capitalize() for _ in range(4))
            left += r.choice(("def ", "import ", "name = ", "class ", ""))
        else:
            c, left = "sha512-" + b64(48), left + 'integrity="'
        if len(c) < LEAST_CHARS:
            c += "." + word(4, 8)
        out.append((c, left[-LEFT_CHARS:], right[:RIGHT_CHARS], path, 0))
    return out + short_findings(words, n // 4, seed)


def _made(r: random.Random, words, syllables: list[str], a: int, b: int) -> str:
    """A made-up word of a to b syllables, or about as many letters of given words one after another."""
    n = r.randint(a, b)
    if not words or r.random() < 0.25:
        return "".join(r.choice(syllables) for _ in range(n))
    out = r.choice(words)
    while len(out) < 2 * n:
        out += r.choice(words)
    return out


def short_findings(words: list[str], n: int, seed: int) -> list[tuple[str, str, str, str, int]]:
    """The same for values of less than 16 characters or with signs in them: passwords and short keys; words, numbers and placeholders."""
    r = random.Random(seed + 1)
    lower, upper, digits, signs = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!@#$%^&*?+-_"
    syllables = [a + b for a in ("th", "er", "st", "n", "r", "l", "sch", "m", "p", "v", "t", "h", "s", "d") for b in ("a", "e", "i", "on", "en", "ou", "an", "ing")]
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda a, b: _made(r, words, syllables, a, b)
    prose = lambda: " ".join(word(1, 3) for _ in range(r.randint(2, 6)))
    secret = ("password", "Password", "passwd", "pwd", "DB_PASSWORD", "secret", "client_secret", "api_key", "API key", "apikey", "token", "auth_token", "access_key")
    plain = ("name", "count", "note", "title", "lang", "user", "version", "id", "size", "host", "page", "Note", "that is", "path", "color", "date")
    assign = ('="', ' = "', ': "', "=", " = ", ": ", "='", '": "')
    out = []
    while len(out) < n:
        left, right = prose() + " ", r.choice(('" ', '"', "' ", " ", "\n", "")) + prose()
        mixed = lambda: "".join(r.sample(x := list(pick(lower, r.randint(3, 6)) + pick(upper, r.randint(0, 4)) + pick(digits, r.randint(1, 4)) + pick(signs, r.randint(0, 3))), len(x)))
        if len(out) % 2:
            kind = r.randrange(5)
            if kind == 0:
                c = word(1, 3) + pick(digits, r.randint(1, 4)) + r.choice(("", pick(lower, 2), pick(signs, 1)))
            elif kind == 1:
                c = pick(lower + upper + digits, r.randint(8, 15))
            elif kind == 2:
                c = pick("0123456789abcdef", r.randint(8, 15))
            elif kind == 3:
                c = r.choice(signs).join(word(1, 2).capitalize() for _ in range(r.randint(2, 4))) + pick(digits, r.randint(1, 3)) + pick(signs, r.randint(0, 2))
            else:
                c = mixed()
            left += r.choice(secret) + r.choice((*assign, " ", " is "))
            y = 1
        else:
            kind, y = r.randrange(6), 0
            if kind == 0:
                c, left = word(1, 5), left + r.choice((*plain, word(1, 3))) + r.choice(assign)
            elif kind == 1:
                c, left = word(1, 5) + r.choice(("", ".", ",", "!")), left + r.choice(secret) + r.choice((" ", " is ", ": "))
            elif kind == 2:
                c = r.choice(("changeme", "change-me", "your_key", "example", "dummy", "xxxxxxxx", "********", "None", "null", "true", "false", "required", "placeholder", "sample123", "test1234", "${TOKEN}", "<password>", "123456"))
                left += r.choice(secret) + r.choice(assign)
            elif kind == 3:
                c, left = pick(digits, r.randint(4, 12)), left + r.choice(plain) + r.choice(assign)
            elif kind == 4:
                c = r.choice((f"v{r.randint(0, 9)}.{r.randint(0, 99)}.{r.randint(0, 9)}", f"20{pick(digits, 2)}-{pick(digits, 2)}-{pick(digits, 2)}", f"{pick(digits, 2)}:{pick(digits, 2)}:{pick(digits, 2)}", "en-US", f"#{pick('0123456789abcdef', 6)}", f"{word(1, 2)}@{word(1, 2)}.org", f"/{word(1, 2)}/{word(1, 2)}", f"{word(1, 2)}{r.randint(1, 9)}"))
                left += r.choice(plain) + r.choice(assign)
            else:
                c, left = mixed(), left + r.choice(plain) + r.choice(assign)
        c = c[: LEAST_CHARS - 1] if c.isalnum() else c
        if len(c) < 4:
            c += word(2, 3)[:8]
        out.append((c, left[-LEFT_CHARS:], right[:RIGHT_CHARS], r.choice(("", "src0", "src7", ".env", "web", "notes", "deploy/prod.yml")), y))
    return out


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int):
    """A tree: a share of secrets, or (feature, threshold, tree at most the threshold, tree above)."""
    p = float(y.mean())
    if depth == 0 or len(y) < 2 * LEAF or p in (0.0, 1.0):
        return round(p, 4)
    best = None
    for f in rng.choice(x.shape[1], max(2, int(np.sqrt(x.shape[1]))), replace=False):
        v = x[:, f]
        for t in np.unique(np.quantile(v, np.linspace(0.04, 0.96, 24), method="lower")):
            low = v <= t
            k = int(low.sum())
            if k < LEAF or len(y) - k < LEAF:
                continue
            a, b = y[low].mean(), y[~low].mean()
            impurity = k * a * (1 - a) + (len(y) - k) * b * (1 - b)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, int(f), float(t), low)
    if best is None:
        return round(p, 4)
    _, f, t, low = best
    return f, t, grow(x[low], y[low], rng, depth - 1), grow(x[~low], y[~low], rng, depth - 1)


def forest(x: np.ndarray, y: np.ndarray, seed: int = 3) -> list:
    rng = np.random.default_rng(seed)
    trees = []
    for _ in range(TREES):
        rows = rng.integers(0, len(y), len(y))
        trees.append(grow(x[rows], y[rows], rng, DEPTH))
    return trees


def vote(trees: list, x: np.ndarray) -> float:
    total = 0.0
    for t in trees:
        while isinstance(t, tuple):
            t = t[2] if x[t[0]] <= t[1] else t[3]
        total += t
    return total / len(trees)


def _votes(trees: list, f: Column) -> Column:
    """The forest's mean vote on a struct of features."""

    def column(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        k, t, low, high = tree
        return F.when(f[FEATURES[k]] <= F.lit(t), column(low)).otherwise(column(high))

    total = column(trees[0])
    for tree in trees[1:]:
        total = total + column(tree)
    return total / F.lit(float(len(trees)))


@dataclass(frozen=True)
class Scanner:
    trees: list
    words: str


def trained(docs: DataFrame, findings: list | DataFrame | None = None, text_col: str = "text") -> Scanner:
    """The dictionary of ``docs``, and the forest from the features that Spark gives the labelled findings."""
    spark, found = docs.sparkSession, dictionary(docs, text_col)
    words = pattern_of(found)
    if findings is None:
        findings = labelled_findings(found)
    if isinstance(findings, list):
        findings = spark.createDataFrame(findings, "c string, l string, r string, p string, y int")
    rows = findings.where("c is not null and y is not null").orderBy(F.xxhash64("c", "l", "r", "p"), "c", "l", "r", "p", "y").limit(FINDINGS)
    text = [F.coalesce(k, F.lit("")).alias(k) for k in ("c", "l", "r", "p")]
    got = rows.select(*text, "y").select(features(F.struct("c", "l", "r", "p"), words).alias("f"), "y").collect()
    if not got:
        return Scanner([0.0], words)
    return Scanner(forest(np.array([list(g["f"]) for g in got]), np.array([g["y"] for g in got], float)), words)


def scored(text: Column, path: Column, scanner: Scanner) -> tuple[Column, Column]:
    """An array of (l, c, s): the text before each candidate, itself, its score; and the text after the last candidate.

    Each candidate's features are bound once, as the only element of an array, before the trees look at them.
    """
    once = F.array(F.struct(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("f"), F.split(text, CANDIDATE, -1).alias("p")))
    rows = F.element_at(F.transform(once, lambda z: _scored(z["f"], z["p"], path, scanner)), 1)
    return rows, F.element_at(F.split(text, CANDIDATE, -1), -1)


def _scored(found: Column, pieces: Column, path: Column, scanner: Scanner) -> Column:
    n = F.size(pieces) - 1
    # what a short value stands after belongs to the text before it
    heads = F.transform(found, lambda f: F.when(f.rlike(f"^{_LONG}$"), F.lit("")).otherwise(F.regexp_extract(f, f"^{_HEAD}{_QUOTE}?", 0)))
    cut = F.arrays_zip(found.alias("f"), heads.alias("h"), F.slice(pieces, F.lit(1), n).alias("p"))
    cut = F.transform(cut, lambda x: F.struct(F.concat(x["p"], x["h"]).alias("l"), F.substring(x["f"], F.length(x["h"]) + 1, F.length(x["f"])).alias("c")))
    return F.element_at(F.transform(F.array(cut), lambda z: _with_context(z, F.element_at(pieces, -1), path, scanner)), 1)


def _with_context(cut: Column, last: Column, path: Column, scanner: Scanner) -> Column:
    n = F.size(cut)
    lefts = F.transform(cut, lambda x: x["l"])
    # a short candidate beside another one stays in its context
    brief = F.transform(cut, lambda x: F.when(F.length(x["c"]) < LEAST_CHARS, x["c"]).otherwise(F.lit("")))
    before = F.transform(cut, lambda x: F.when(F.length(x["c"]) >= LEAST_CHARS, F.lit("")).otherwise(F.concat(F.right(x["l"], F.lit(LEFT_CHARS)), x["c"])))
    zipped = F.arrays_zip(
        cut.alias("x"), F.slice(F.concat(lefts, F.array(last)), F.lit(2), n).alias("r"),
        F.slice(F.concat(F.array(F.lit("")), before), F.lit(1), n).alias("b"), F.slice(F.concat(brief, F.array(F.lit(""))), F.lit(2), n).alias("a"),
    )

    def one(z: Column) -> Column:
        x = z["x"]
        seen = F.struct(x["c"].alias("c"), F.concat(z["b"], x["l"]).alias("l"), F.concat(z["r"], z["a"]).alias("r"), path.alias("p"))
        score = F.element_at(F.transform(F.array(features(seen, scanner.words)), lambda f: _votes(scanner.trees, f)), 1)
        return F.struct(x["l"].alias("l"), x["c"].alias("c"), score.alias("s"))

    return F.transform(zipped, one)


def scan(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """A row for each candidate: doc_id, finding (its number in the text), candidate, start (code points before it),
    n_chars, crc32, score, is_secret."""
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows, _ = scored(F.col(text_col), path, scanner)
    rows = docs.where(F.col(text_col).rlike(CANDIDATE)).select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(placed(rows)).alias("finding", "x"))
    return rows.select("doc_id", F.col("finding").cast("long").alias("finding"), F.col("x.c").alias("candidate"), F.col("x.at").alias("start"), F.length("x.c").cast("long").alias("n_chars"), F.crc32(F.encode("x.c", "UTF-8")).alias("crc32"), F.round("x.s", 6).alias("score"), (F.col("x.s") >= CUT).alias("is_secret"))


def placed(rows: Column) -> Column:
    """(c, s, at) of each candidate: at counts the code points before it, the sum of what stands before."""

    def of(found: Column) -> Column:
        ends = lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x["l"]) + F.length(x["c"])))
        to = F.slice(F.aggregate(found, F.array(F.lit(0)), ends), F.lit(2), F.size(found))  # where each candidate ends
        return F.transform(F.arrays_zip(found.alias("x"), to.alias("e")), lambda z: F.struct(z["x"]["c"].alias("c"), z["x"]["s"].alias("s"), (z["e"] - F.length(z["x"]["c"])).cast("long").alias("at")))

    return F.element_at(F.transform(F.array(rows), of), 1)  # bound once


def redact(docs: DataFrame, scanner: Scanner, text_col: str = "text", path_col: str | None = "source", count_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every secret replaced by ``SECRET``; ``count_col`` is counted anew for the texts that change."""
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows, last = scored(F.col(text_col), path, scanner)
    parts = F.transform(rows, lambda x: F.concat(x["l"], F.when(x["s"] >= CUT, F.lit(SECRET)).otherwise(x["c"])))
    clean = F.when(F.col(text_col).rlike(CANDIDATE), F.concat(F.array_join(parts, ""), last)).otherwise(F.col(text_col))
    own = "_clean"
    while own in docs.columns:
        own += "_"
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.col(own).alias(c))
        elif c == count_col:
            out.append(F.when(F.col(own) != F.col(text_col), F.length(own).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return docs.withColumn(own, clean).select(*out)


def op3_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, trained(docs)).drop("candidate")  # its digest stands for it


QUERIES = {"op3_secret_forest": op3_secret_forest}
ORACLE: dict[str, str] = {}
