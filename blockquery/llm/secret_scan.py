"""Secret scan: candidates by one expression, false positives removed by a random forest compiled to SQL.

A candidate is a whole run of at least 16 characters of keys (letters, digits, + / _ -), however long, or a quoted value of
any length and characters on one line that is assigned to a name of secrets (password = "..."), with the words before and
after it and the document's path. Its features are its length, entropy and character transitions, the share that
dictionary words cover (the whole words of a public tokenizer's vocabulary, whose path is a parameter, as a bit set), what
its path says, and its neighbouring words, each hashed into one of `BUCKETS` features, so that the forest learns what they
mean. The forest is trained by MLlib from labelled findings, a small table, and its trees become nested CASE expressions, so
that scanning is one pass over the documents with built-in functions and no shuffle: no Python runs on executors. The
default findings are generated shapes with words of one half of the dictionary; tests judge shapes with the other half.

Null text has no candidates. A value that stands several times in a document is judged at each place; it is one finding
with its first start and its highest score, and `find_occurrences` has a row for each place. A score that ties with the
threshold is a secret. Repeated rows and equal ids are judged each on their own. A null path says nothing. A very long text
is scanned in its task as a whole. An empty table gives an empty result. Labelled findings of one kind only give that
verdict on every candidate; with none at all there is nothing to tell false positives by, and every candidate is a secret.
Findings need doc_id, text and the path column; `redact` keeps every column it is given.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import default_vocabulary, documents, fresh

# possessive everywhere: linear, and without a stack that grows with the text
CANDIDATE = r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}+={0,2}"
BEFORE, AFTER = 48, 32
THRESHOLD = 0.5
TREES, DEPTH, SEED = 25, 7, 7
MASK = "[secret]"

_BIGRAMS = "th he in er an re nd at on nt ha es st en ed to it ou ea is or ti as te et ng of al de se le ar ve ra ur ro io co me ic".split()
_SECRET_WORDS = r"token|secret|passw|pwd|api.?key|access.?key|auth|credential|private|bearer|signing|encrypt"
_ASSIGNED_TO = rf"(?i)(?:{_SECRET_WORDS})[A-Za-z0-9_.\-]{{0,32}}[\"'`]?\]?[ \t]{{0,4}}(?:=>|:=|={{1,3}}|:)[ \t]{{0,4}}"
#: An assigned value in quotes; a quote after a backslash does not end it.
ASSIGNED = _ASSIGNED_TO + "(?:" + "|".join(rf"{q}(?:[^{q}\\\n]|\\[^\n])++{q}" for q in "\"'`") + ")"
#: The shortest: pwd="x"
LEAST_ASSIGNED = 7
_TEST_PATHS = r"test|example|sample|fixture|mock|docs?/|vendor|readme|demo"
_PREFIX = r"^(AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live|rk_live|eyJ|AIza|glpat-|npm_|SG)"
_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=", "A" * 26 + "a" * 26 + "0" * 10 + "-" * 5)
FEATURES = ("length", "digits", "uppers", "transitions", "distinct", "entropy", "bigrams", "coverage", "hex", "dashes", "prefix", "test_path", "secret_word", "assigned", "in_url", "quoted", "has_digit", "marks", "spaces")
#: Buckets of the words before and of those after, and how many words on either side count.
BUCKETS, NEAR, BEHIND = 24, 4, 2
FEATURES += tuple(f"before_{i}" for i in range(BUCKETS)) + tuple(f"after_{i}" for i in range(BUCKETS))
#: Bits of the dictionary.
DICTIONARY_BITS = 1 << 19


@lru_cache(maxsize=4)
def dictionary(path: str | None = None) -> tuple[str, ...]:
    """Whole words of 4 to 15 letters in a tokenizer's vocabulary, sorted."""
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return tuple(sorted(w for w in (v.removesuffix("</w>") for v in vocabulary if v.endswith("</w>")) if 4 <= len(w) <= 15 and w.isascii() and w.isalpha() and w.islower()))


@lru_cache(maxsize=4)
def _dictionary_bits(path: str | None = None) -> bytes:
    bits = bytearray(DICTIONARY_BITS // 8)
    for w in dictionary(path):
        h = zlib.crc32(w.encode()) % DICTIONARY_BITS
        bits[h >> 3] |= 1 << (h & 7)
    return bytes(bits)


def _in_dictionary(word: Column, path: str | None) -> Column:
    h = F.crc32(word.cast("binary")) % F.lit(DICTIONARY_BITS)
    byte = F.conv(F.hex(F.substring(F.lit(_dictionary_bits(path)), (F.shiftright(h, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (h % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def near_words(before: Column) -> Column:
    """Buckets of the last words before a candidate."""
    words = F.slice(F.reverse(F.regexp_extract_all(F.lower(before), F.lit("[a-z]{2,}"), F.lit(0))), 1, NEAR)
    return F.transform(words, lambda w: (F.crc32(w.cast("binary")) % F.lit(BUCKETS)).cast("int"))


def words_behind(after: Column) -> Column:
    words = F.slice(F.regexp_extract_all(F.lower(after), F.lit("[a-z]{2,}"), F.lit(0)), 1, BEHIND)
    return F.transform(words, lambda w: (F.crc32(w.cast("binary")) % F.lit(BUCKETS)).cast("int"))


def _count(c: Column, pattern: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def features(value: Column, before: Column, after: Column, path: Column, near: Column | None = None, behind: Column | None = None, vocabulary: str | None = None) -> dict[str, Column]:
    """All features by name. near and behind: near_words and words_behind, where these are at hand."""
    near, behind = near_words(before) if near is None else near, words_behind(after) if behind is None else behind
    pieces = F.transform(F.regexp_extract_all(value, F.lit("[A-Z]?[a-z]{3,}|[A-Z]{4,}"), F.lit(0)), F.lower)
    covered = F.aggregate(F.filter(pieces, lambda w: _in_dictionary(w, vocabulary)), F.lit(0), lambda total, w: total + F.length(w))
    n = F.length(value).cast("double")
    classes = F.translate(value, *_CLASSES)
    chars = F.array_distinct(F.split(value, ""))
    share = lambda ch: (F.length(value) - F.length(F.replace(value, ch, F.lit("")))) / F.length(value)
    entropy = F.aggregate(F.filter(chars, lambda ch: ch != ""), F.lit(0.0), lambda acc, ch: acc - share(ch) * F.log2(share(ch)))
    low = F.lower(value)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return {
        "length": n,
        "digits": _count(value, "[0-9]") / n,
        "uppers": _count(value, "[A-Z]") / n,
        "transitions": (F.length(F.regexp_replace(classes, r"(.)\1*", "$1")) - 1) / n,
        "distinct": F.size(chars) / n,
        "entropy": entropy,
        "bigrams": F.size(F.regexp_extract_all(low, F.lit(f"(?=({'|'.join(_BIGRAMS)}))"), F.lit(1))) / n,
        "coverage": covered / n,
        "hex": flag(F.length(F.regexp_replace(low, "[0-9a-f]", "")) == 0),
        "dashes": _count(value, r"[_/\-]") / n,
        "prefix": flag(value.rlike(_PREFIX)),
        "test_path": flag(F.lower(path).rlike(_TEST_PATHS)),
        "secret_word": flag(F.lower(before).rlike(f"({_SECRET_WORDS})[^\\n]{{0,24}}$")),
        "assigned": flag(before.rlike("(=|:|=>)\\s*[\"'`]?$")),
        "in_url": flag(before.rlike(r"(://|www\.|\.com/|[a-z0-9]/)\S*$")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "has_digit": flag(value.rlike("[0-9]")),
        "marks": _count(value, r"[^A-Za-z0-9+/_\-=\s]") / n,
        "spaces": _count(value, r"\s") / n,
        **{f"before_{i}": F.array_contains(near, i).cast("double") for i in range(BUCKETS)},
        **{f"after_{i}": F.array_contains(behind, i).cast("double") for i in range(BUCKETS)},
    }


# --- labelled findings ---------------------------------------------------------------------------


def labelled_findings(n: int = 4000, seed: int = SEED, words: tuple[str, ...] | None = None) -> list[tuple[str, str, str, str, int]]:
    """(value, before, after, path, label) of n reviewed shapes: credentials (1), and what scanners often take for them (0). words: what fills them, every other of the dictionary by default."""
    r, out, words = random.Random(seed), [], words or dictionary()[::2]
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    hexes, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    filler = lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 5)))
    keys = ("token", "api_key", "secret", "password", "access_key", "auth_token", "client_secret", "private_key", "apiKey", "credential", "Bearer", "signing_key")
    paths = ("src/main.py", "config/prod.env", "app/settings.yml", "deploy/values.yaml", "lib/client.js", "notes.txt", "")
    tests = ("tests/test_client.py", "examples/demo.py", "docs/guide.md", "fixtures/sample.json", "vendor/lib.js", "README.md")
    for _ in range(n // 2):
        value = r.choice(
            (
                lambda: pick(hexes, r.choice((32, 40, 40, 48, 64))),
                lambda: pick(alnum, r.randint(20, 44)),
                lambda: pick(alnum + "+/", 40),
                lambda: "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16),
                lambda: "ghp_" + pick(alnum, 36),
                lambda: "sk_live_" + pick(alnum, 24),
                lambda: "xoxb-" + pick("0123456789", 12) + "-" + pick(alnum, 24),
                lambda: pick(alnum + "_-", r.randint(18, 32)),
                lambda: pick(alnum[:52], r.randint(18, 44)),
                lambda: pick(alnum + "+/", r.choice((128, 300, 600, 1600))),
                lambda: r.choice("!&#%@$") + pick(alnum + "!&#%@$*?.", r.randint(7, 18)),
                lambda: pick(alnum, r.randint(4, 10)) + pick("!&#%@$*?", 1) + pick(alnum, r.randint(3, 8)),
                lambda: r.choice(words).capitalize() + pick("0123456789", r.randint(1, 4)) + pick("!&#%@$*?", r.randint(1, 2)),
            )
        )()
        quote = r.choice(('"', '"', "'", "", "`"))
        known = bool(re.match(_PREFIX, value))
        if re.search("[^A-Za-z0-9+/_-]", value) or len(value) < 16:
            quote = r.choice(('"', "'", "`"))  # such values are candidates in quotes only
        before = filler() + (" " if known and r.random() < 0.4 else f" {r.choice(keys)}{r.choice((' = ', ': ', '=', ' : ', ' => ', *([] if len(value) < 16 else [' '])))}") + quote
        out.append((value, before, quote + " " + filler(), r.choice(paths), 1))
    for _ in range(n - n // 2):
        shape = r.randrange(15)
        quote, path, key = r.choice(('"', "'", "", "")), r.choice(paths), r.choice(keys)
        before, after = filler() + " ", " " + filler()
        if shape == 0:  # digests and revisions
            value, before = pick(hexes, r.choice((32, 40, 64))), before + r.choice(("commit ", "sha256: ", "md5 = ", "checksum ", "revision: ", "etag: ", "digest=", "integrity: "))
        elif shape == 1:
            value, before = "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), before + r.choice(("uuid ", "id: ", "guid=", ""))
        elif shape == 2:  # identifiers made of words
            value = r.choice(("_", "-", "")).join([r.choice(words) for _ in range(r.randint(3, 5))] + [str(r.randint(1, 99))])
        elif shape == 3:  # placeholders under a secret's name
            value, before = r.choice(("your_", "insert_", "example_", "my_", "test_", "changeme_", "replace_")) + r.choice(keys).lower() + "_here_" + str(r.randint(0, 999)), before + key + " = " + quote
        elif shape == 4:  # long numbers
            value, before = pick("0123456789", r.randint(16, 24)), before + r.choice(("", "card ", "order ", "account number ", "tracking "))
        elif shape == 5:  # parts of addresses
            value, before = pick(alnum, r.randint(16, 30)) + "-" + r.choice(words), before + "https://www." + r.choice(words) + ".com/" + r.choice(words) + "/"
        elif shape == 6:  # real shapes in tests and examples
            value, before, path = pick(alnum, r.randint(20, 40)), before + r.choice(("example ", "dummy ", "sample ")) + key + " = " + quote, r.choice(tests)
        elif shape == 7:  # rules and repeated characters
            value = r.choice("-_=x0") * r.randint(16, 40) + str(r.randint(0, 9))
        elif shape == 8:  # words of prose run together, with a number
            value = "".join(r.choice(_BIGRAMS) for _ in range(r.randint(8, 16))) + str(r.randint(0, 2030))
        elif shape == 10:  # names and paths without a digit
            value, before = r.choice(("_", "-", "/", "/")).join(r.choice(words) for _ in range(r.randint(3, 9))), before + r.choice(("", "", '"', "import ", "see ", "/", key + ": "))
        elif shape == 11:  # long words, and words in capitals run together
            value = r.choice(("".join(r.choice(_BIGRAMS) for _ in range(r.randint(8, 20))), "".join(r.choice(words).capitalize() for _ in range(r.randint(3, 6)))))
            before += r.choice(("", "", "class ", key + " "))
        elif shape == 12:  # rules
            value = r.choice("-_/+") * r.randint(16, 90)
        elif shape == 13:  # words, messages and names under a secret's name
            quote = r.choice(('"', "'", "`"))
            value = r.choice((lambda: r.choice(words), lambda: filler() + " " + r.choice(words), lambda: r.choice(words).capitalize() + " " + filler() + ".", lambda: "${" + r.choice(words).upper() + "}", lambda: "<" + r.choice(words) + ">", lambda: "_".join(r.choice(words) for _ in range(2)), lambda: "*" * r.randint(4, 12)))()
            before, after = before + key + r.choice((" = ", ": ", "=", " => ")) + quote, quote + after
        elif shape == 14:  # pictures and files as text
            value, before = pick(alnum + "+/", r.choice((60, 128, 300, 600, 1600))), before + r.choice(("data:image/png;base64,", "src=data:image/gif;base64,", "integrity=sha512-", "data:font/woff;base64,"))
        else:  # keys that only look assigned
            value, before = "".join(r.choice(words).capitalize() for _ in range(r.randint(3, 5))) + str(r.randint(0, 9)), before + r.choice(("class ", "name: ", "id = ", "version=")) + quote
        out.append((value, before, quote + after, path, 0))
    return out


def findings_table(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(labelled_findings() if rows is None else rows, "value string, before string, after string, path string, label int")


# --- the forest ----------------------------------------------------------------------------------


def train_forest(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list:
    """Trees as nested [feature, threshold, left, right] with votes (0.0 or 1.0) as leaves, from labelled findings; a leaf alone where these are not of both kinds."""
    findings = findings.where("label IS NOT NULL AND length(value) > 0")  # anything less is no finding
    kinds = [r[0] for r in findings.select(F.col("label").cast("double")).distinct().limit(3).collect()]
    if len(kinds) < 2:
        return [float(kinds[0] > 0) if kinds else 1.0]
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    findings = findings.select("label", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("value", "before", "after", "path")))
    rows = findings.select(F.col("label").cast("double").alias("label"), *(c.cast("double").alias(n) for n, c in features(*(F.col(c) for c in ("value", "before", "after", "path"))).items()))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.coalesce(1))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", subsamplingRate=0.8).fit(rows)
    return [_parse(t.toDebugString) for t in model.trees]


_DEFAULT: dict[tuple, list] = {}


def _forest(spark: SparkSession, findings: DataFrame | None) -> list:
    """The forest of these findings; that of the default ones is trained once in a session."""
    if findings is not None:
        return train_forest(findings)
    key = (spark.sparkContext.applicationId, TREES, DEPTH, SEED)
    if key not in _DEFAULT:
        _DEFAULT[key] = train_forest(findings_table(spark))
    return _DEFAULT[key]


def used_features(forest: list) -> set[str]:
    def walk(node) -> set[str]:
        return set() if isinstance(node, float) else {FEATURES[node[0]]} | walk(node[2]) | walk(node[3])

    return set().union(*map(walk, forest))


def _parse(text: str) -> list | float:
    lines = [x.strip() for x in text.split("\n")[1:] if x.strip()]

    def node(i: int):
        if lines[i].startswith("Predict"):
            return float(lines[i].split(":")[1]), i + 1
        m = re.match(r"If \(feature (\d+) <= ([-\d.eE]+)\)", lines[i])
        left, i = node(i + 1)
        right, i = node(i + 1)  # past the Else line
        return [int(m[1]), float(m[2]), left, right], i

    return node(0)[0]


def _tree(node: list | float, get) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    feature, threshold, left, right = node
    if left == right:
        return _tree(left, get)
    return F.when(get(FEATURES[feature]) <= threshold, _tree(left, get)).otherwise(_tree(right, get))


def forest_score(forest: list, get) -> Column:
    """The share of trees that vote for a secret."""
    return reduce(lambda a, b: a + b, (_tree(t, get) for t in forest)) / float(len(forest))


# --- scanning ------------------------------------------------------------------------------------


def _let(value: Column, body) -> Column:
    """body of a value that is computed once: inside a function of an array, a column is computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _positions(lengths: Column) -> Column:
    """The running sums before each length, gathered in blocks: appending to one array would copy it for each element."""
    ints = F.array().cast("array<int>")

    def step(acc: Column, n: Column) -> Column:
        full = F.size(acc["block"]) >= 256
        done = F.when(full, F.concat(acc["done"], F.array(acc["block"]))).otherwise(acc["done"])
        block = F.concat(F.when(full, ints).otherwise(acc["block"]), F.array(acc["total"]))
        return F.struct((acc["total"] + n).alias("total"), block.alias("block"), done.alias("done"))

    start = F.struct(F.lit(0).alias("total"), ints.alias("block"), F.array().cast("array<array<int>>").alias("done"))
    return F.aggregate(lengths, start, step, lambda acc: F.concat(F.flatten(acc["done"]), acc["block"]))


def _walk(text: Column, pattern: str, least: int) -> Column:
    """An array of (match, at, before, after) of every match at its own place; no match is shorter than `least`.

    Contexts are put together from the text between the matches and as many neighbouring matches as can lie in them.
    """
    back, ahead = -(-BEFORE // least), -(-AFTER // least)
    whole = F.struct(F.split(text, pattern).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))

    def placed(w: Column) -> Column:
        gap = lambda i: F.coalesce(F.get(w["gaps"], i), F.lit(""))
        match = lambda i: F.coalesce(F.get(w["matches"], i), F.lit(""))
        lengths = F.zip_with(w["gaps"], w["matches"], lambda g, m: F.coalesce(F.length(g), F.lit(0)) + F.coalesce(F.length(m), F.lit(0)))

        def one(m: Column, i: Column, at: Column) -> Column:
            before = F.concat(*(part for k in range(back, -1, -1) for part in ((match(i - k - 1) if k < back else F.lit("")), gap(i - k))))
            after = F.concat(*(part for k in range(ahead) for part in (gap(i + 1 + k), match(i + 1 + k))))
            return F.struct(m.alias("match"), (F.get(at, i) + F.length(gap(i)) + 1).alias("at"), F.substring(before, -BEFORE, BEFORE).alias("before"), F.substring(after, 1, AFTER).alias("after"))

        return _let(_positions(lengths), lambda at: F.transform(w["matches"], lambda m, i: one(m, i, at)))

    return _let(whole, placed)


def occurrences(text: Column, path: Column, forest: list) -> Column:
    """An array of (value, start, score) of every candidate of a text, each judged where it stands."""
    runs = F.transform(_walk(text, CANDIDATE, 16), lambda c: F.struct(c["match"].alias("value"), c["at"].alias("start"), c["before"].alias("before"), c["after"].alias("after")))

    def quoted(c: Column, name: Column) -> Column:
        return F.struct(
            F.substring(c["match"], F.length(name) + 1, F.length(c["match"]) - F.length(name) - 1).alias("value"),
            (c["at"] + F.length(name)).alias("start"),
            F.substring(F.concat(c["before"], name), -BEFORE, BEFORE).alias("before"),
            F.substring(F.concat(F.substring(c["match"], -1, 1), c["after"]), 1, AFTER).alias("after"),
        )

    assigned = F.transform(_walk(text, ASSIGNED, LEAST_ASSIGNED), lambda c: _let(F.regexp_extract(c["match"], "^" + _ASSIGNED_TO + "[\"'`]", 0), lambda name: quoted(c, name)))
    # a run in quotes that is assigned is found by both, with the same place and context
    both = F.transform(F.array_distinct(F.concat(runs, assigned)), lambda c: F.struct(*(c[k].alias(k) for k in ("value", "start", "before", "after")), near_words(c["before"]).alias("near"), words_behind(c["after"]).alias("behind")))
    used = used_features(forest)

    def described(c: Column) -> Column:
        own = features(c["value"], c["before"], c["after"], path, c["near"], c["behind"])
        return F.struct(c["value"].alias("value"), c["start"].alias("start"), *(f.cast("double").alias(n) for n, f in own.items() if n in used))

    return F.transform(F.transform(both, described), lambda c: F.struct(c["value"].alias("value"), c["start"].alias("start"), forest_score(forest, lambda n: c[n]).alias("score")))


def scored(text: Column, path: Column, forest: list) -> Column:
    """An array of (value, start, score, secret) of a text's distinct candidates, in order of first appearance: the first start and the highest score of each."""

    def heads(o: Column) -> Column:
        # both orders have a value's places side by side, so its first start and its highest score have one index
        first = lambda i: F.get(o["by_start"], i)
        own = F.filter(F.sequence(F.lit(0), F.size(o["by_start"]) - 1), lambda i: (i == 0) | (first(i)["value"] != first(i - 1)["value"]))
        return F.transform(own, lambda i: F.struct(first(i)["start"].alias("start"), first(i)["value"].alias("value"), (-F.get(o["by_score"], i)["order"]).alias("score")))

    by_score = lambda found: F.sort_array(F.transform(found, lambda c: F.struct(c["value"].alias("value"), (-c["score"]).alias("order"))))
    both = _let(occurrences(text, path, forest), lambda found: F.struct(F.sort_array(found).alias("by_start"), by_score(found).alias("by_score")))
    judged = _let(both, lambda o: F.when(F.size(o["by_start"]) > 0, heads(o)))
    return F.transform(F.sort_array(judged), lambda c: F.struct(c["value"].alias("value"), c["start"].alias("start"), c["score"].alias("score"), (c["score"] >= THRESHOLD).alias("secret")))


def find_occurrences(docs: DataFrame, findings: DataFrame | None = None, path: str = "source") -> DataFrame:
    """A row for each place of each candidate, judged by itself: doc_id, value, start (from 1), score and secret."""
    forest = _forest(docs.sparkSession, findings)
    found = docs.select("doc_id", F.explode(occurrences(F.col("text"), F.col(path), forest)).alias("f"))
    return found.select("doc_id", "f.value", "f.start", "f.score", (F.col("f.score") >= THRESHOLD).alias("secret"))


def find_secrets(docs: DataFrame, findings: DataFrame | None = None, path: str = "source") -> DataFrame:
    """A row for each distinct candidate of a document: doc_id, value, start (from 1) of its first place, its highest score and secret."""
    forest = _forest(docs.sparkSession, findings)
    found = docs.select("doc_id", scored(F.col("text"), F.col(path), forest).alias("found"))
    return found.where(F.size("found") > 0).select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.value", "f.start", "f.score", "f.secret")


def redact(docs: DataFrame, findings: DataFrame | None = None, path: str = "source", mask: str = MASK) -> DataFrame:
    """The documents with every secret masked wherever it stands (one under 16 characters not within a longer word), and n_chars counted again."""
    forest = _forest(docs.sparkSession, findings)
    name = fresh(docs, "__secrets")
    secrets = F.filter(scored(F.col("text"), F.col(path), forest), lambda c: c["secret"])
    # longer values first: one may be part of another
    ordered = F.array_sort(F.transform(secrets, lambda c: F.struct((-F.length(c["value"])).alias("order"), c["value"].alias("value"))))

    def masked(acc: Column, c: Column) -> Column:
        literal = F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.replace(c["value"], F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9])"))
        return F.when(F.length(c["value"]) < 16, F.regexp_replace(acc, literal, F.lit(re.sub(r"([\\$])", r"\\\1", mask)))).otherwise(F.replace(acc, c["value"], F.lit(mask)))

    text = F.when(F.size(F.col(name)) > 0, F.aggregate(F.col(name), F.col("text"), masked)).otherwise(F.col("text"))
    out = docs.withColumn(name, ordered).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(F.col(name)) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    return found.select("doc_id", "start", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score", "secret")


QUERIES = {"op2_secret_scan": op2_secret_scan}
ORACLES: dict[str, str] = {}
