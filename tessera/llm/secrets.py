"""Secret scans: candidate tokens, judged by a random forest.

A candidate is a value assigned to a secret's name, whatever its characters and
length; a private key block; a run with a known prefix, and what follows it in
a signed token; or a maximal run of letters, digits and ``+ / _ -`` with a digit
and LEAST characters or more. Its length, character transitions, dictionary
coverage, path and neighbouring words go to a forest that was trained on
labelled findings and drops false positives. The forest lies in flat arrays
and is walked by column expressions, so a scan is one pass without a shuffle.

Labelled findings are a table ``value, before, after, path, label``; without
one, ``labelled_findings`` makes a documented set of ROWS rows from a seed.
Training runs on the driver over at most MOST_LABELLED of them.

Defined cases: null and empty texts have no candidate; a null path is empty;
texts are read whole; repeated rows give repeated results.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm import scratch

LEAST = 16
ROWS = 1_500
MOST_LABELLED = 20_000
THRESHOLD = 0.5
MARK = "[REDACTED]"
TREES, DEPTH = 24, 7

_RUN = "[A-Za-z0-9+/_-]"
_NAMES = "secret|token|passw|pwd|api.?key|auth|credential|private|bearer|access"
_PREFIX = "(?:AKIA|ASIA|ghp_|gho_|glpat-|sk_live|sk-|xox[abp]-|AIza|eyJ)"
_BLOCK = "[A-Z ]{0,24}PRIVATE KEY(?: BLOCK)?-----"
#: key blocks are far shorter; the bound keeps openings without an end from costing the whole text each
_PEM = rf"-----BEGIN {_BLOCK}[^\x00]{{0,65536}}?-----END {_BLOCK}"
_SIGNED = rf"eyJ{_RUN}++(?:\.{_RUN}++){{1,2}}"
_KNOWN = f"(?:{_PREFIX}|-----BEGIN )"
#: what stands before an assigned value; the first part is cheap and fails at most places
_ASSIGNED = r"[:=][ \t]{0,3}[\"'(]{0,2}"
_ASKED = rf"(?i:{_NAMES})[A-Za-z0-9_.-]{{0,16}}[\"'\])]{{0,2}}[ \t]{{0,3}}:?{_ASSIGNED}"
_VALUE = r"[^\s\"'`,;()<>\[\]{}]"
CANDIDATE = (
    rf"{_PEM}|(?<!{_RUN}){_SIGNED}"
    rf"|(?<={_ASSIGNED})(?<={_ASKED})(?:(?<=\")[^\"\n]++(?=\")|(?<=')[^'\n]++(?=')|(?![:=]){_VALUE}*[^\s\"'`,;()<>\[\]{{}}.?:])"
    rf"|(?<!{_RUN}){_PREFIX}{_RUN}++"
    rf"|(?<!{_RUN})[A-Za-z+/_-]*+[0-9]{_RUN}*+"
)

# Frequent English letter pairs, for character transitions.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra li ch ll be ma si om ur".split()
# Words whose coverage of a candidate speaks for an identifier or placeholder.
DICTIONARY = "placeholder changeme redacted example sample default password username version release profile setting config image static header module report update insert backup client server domain number string object secret token dummy title index table order phone value image width style label value fake mock test user name page file data date time blog post news item your here key api org com www src lib img css doc xxxx 0000 1111 1234 abcd".split()

FEATURES = [
    "length", "digits", "upper", "lower", "hex", "distinct", "class_changes", "common_pairs", "doubled", "covered", "separators",
    "asked_for", "assigned", "benign", "quoted", "test_path", "config_path", "known_prefix", "number", "symbols", "spaces", "call",
]


def features(value: Column, before: Column, after: Column, path: Column) -> Column:
    """The forest's input for one candidate, as an array in the order of FEATURES."""
    n = F.length(value).cast("double")
    low = F.lower(value)

    def share(pattern: str, text: Column = value) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / n

    def flag(text: Column, pattern: str) -> Column:
        return text.rlike(pattern).cast("double")

    dictionary = "|".join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w)))
    return F.array(
        n,
        share("[0-9]"),
        share("[A-Z]"),
        share("[a-z]"),
        flag(value, "^(?:[0-9a-f]+|[0-9A-F]+)$"),
        F.size(F.array_distinct(F.split(value, ""))) / n,
        share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])"),
        share(f"(?=(?:{'|'.join(PAIRS)}))", low),
        share(r"(.)(?=\1)"),
        1.0 - F.length(F.regexp_replace(low, dictionary, "")) / n,
        share("[+/_-]"),
        flag(before, rf"(?i)({_NAMES})[^\n]{{0,16}}$"),
        flag(before, r"[:=]\s{0,3}[\"'(]{0,2}$"),
        flag(before, r"(?i)(sha-?1|sha256|md5|checksum|commit|digest|uuid|guid|etag|revision|hash|card|phone|isbn|serial|order|ref)[^\n]{0,12}$"),
        flag(after, r"^[\"']"),
        flag(path, r"(?i)(test|example|sample|fixture|mock|spec|readme|docs?/)"),
        flag(path, r"(?i)(\.env|config|settings|secret|credential|\.ya?ml|\.ini|\.tf)"),
        flag(value, f"^{_KNOWN}"),
        flag(value, "^[0-9]+$"),
        share("[^A-Za-z0-9+/_ -]"),
        share(" "),
        flag(F.concat(value, F.left(after, F.lit(1))), r"[(\[{]|^[$%<]|^[A-Za-z_]+\.[A-Za-z_.]+"),
    )


def labelled_findings(rows: int = ROWS, seed: int = 11) -> list[dict]:
    """Labelled findings made from a seed: the shapes of credentials, and of what is taken for them."""
    rng = np.random.default_rng(seed)
    hexa, digits, b62 = "0123456789abcdef", "0123456789", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = "report invoice summer holiday profile settings header banner article chapter gallery update release section version example sample user data".split()
    names = ["token", "secret", "api_key", "apiKey", "password", "auth_token", "access_token", "client_secret", "private_key", "TOKEN", "SECRET_KEY", "API_KEY", "PASSWORD"]
    harmless = ["commit", "sha1", "md5", "checksum", "etag", "revision", "digest", "uuid", "hash", "ref"]
    paths = ["src/app.py", "src0", "web/config.yaml", "deploy/.env", "lib/core.js", "tests/test_app.py", "docs/readme.md", "examples/sample.py", "", "notes.txt"]
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chars = lambda alphabet, n: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))
    uuid = lambda: "-".join(chars(hexa, n) for n in (8, 4, 4, 4, 12))
    out = []
    for _ in range(rows):
        good = rng.random() < 0.5
        if good:
            n = int(rng.integers(20, 48))
            value = pick([chars(hexa, 40), chars(hexa, 32), chars(hexa, 64), chars(hexa, 40).upper(), chars(b62, n), chars(b62, n), "AKIA" + chars(b62, 16).upper(), "ghp_" + chars(b62, 36), "sk_live_" + chars(b62, 24), chars(b62 + "+/", 40), uuid()])
            before = pick(words) + " " + pick(names) + pick([' = "', "=", ": ", " = '", ': "', " := "])
            if value.startswith(("AKIA", "ghp_", "sk_live_")) and rng.random() < 0.3:
                before = pick(words) + " "
        else:
            kind = int(rng.integers(8))
            if kind == 0:
                value, before = chars(digits, int(rng.integers(16, 20))), pick(words) + pick([" ", ". ", " card ", " order ", ", ", " token = "])
            elif kind == 1:
                value, before = chars(hexa, pick([32, 40, 64])), pick(words) + " " + pick(harmless) + pick([" ", ": ", " = ", '="'])
            elif kind == 2:
                value, before = uuid(), pick(words) + " " + pick(["uuid: ", "guid=", "id ", "ref ", "etag: "])
            elif kind == 3:
                value, before = pick("-_/") + pick("-_/").join([pick(words) for _ in range(3)]) + chars(digits, 2), pick([" ", "/", " href=\"", "token = ", " name: "])
            elif kind == 4:
                value, before = pick(["xxxxxxxxxxxxxxxx", "your-token-here-", "example_token_", "changeme12345678", "placeholder-key-", "0000000000000000"]) + chars("01234", 4), pick(words) + " " + pick(names) + pick([" = ", ': "'])
            elif kind == 5:
                value, before = f"2024-{chars('01', 2)}-{chars('012', 2)}-{chars(digits, 6)}", pick(words) + " "
            elif kind == 6:
                value, before = "".join(pick(words) for _ in range(3)) + chars(digits, 2), pick(words) + pick([" ", ", ", " = "])
            else:
                value, before = pick(["images/", "static/", "v2/"]) + pick(words) + "/" + chars(digits, 4) + "/" + pick(words), pick(["/", " url: ", " src=\""])
        out.append({"value": value, "before": before, "after": pick(['"', "'", " ", "\n", "", ", "]) if not before.endswith(('"', "'")) else before[-1] + pick([" ", "\n", ","]), "path": pick(paths), "label": int(good)})
    return out


def assigned_findings(rows: int = ROWS, seed: int = 12) -> list[dict]:
    """Labelled findings of the values that only their name or prefix gives away, made from a seed like the others."""
    rng = np.random.default_rng(seed)
    lower, upper, digits, marks = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!@#$%.&*?-_"
    words = "the value none true false null undefined string public private report holiday summer granted denied required optional user admin request settings world house garden between morning people bearer basic other about number".split()
    phrases = ["os.environ", "request.headers", "config.secret_key", "self.token", "process.env.TOKEN", "getpass", "get_token", "settings.API_KEY", "${PASSWORD}", "$TOKEN", "<password>", "your-password", "changeme", "example", "placeholder", "sk-learn", "sk-image", "xxxxxxxx", "********", "enter your password", "must not be empty", "text/html"]
    names = ["password", "passwd", "pwd", "secret", "token", "api_key", "db_password", "auth_token", "client_secret", "Password", "SECRET"]
    paths = ["src/app.py", "src0", "web/config.yaml", "deploy/.env", "lib/core.js", "", "notes.txt"]
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chars = lambda alphabet, n: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))
    shuffled = lambda s: "".join(s[i] for i in rng.permutation(len(s)))
    out = []
    for _ in range(rows):
        if rng.random() < 0.05:  # key blocks and signed tokens need no name
            mixed = lambda n: chars(lower + upper + digits, n)
            block = pick(["RSA ", "EC ", "", "OPENSSH ", "ENCRYPTED "]) + "PRIVATE KEY-----"
            value = pick([f"-----BEGIN {block}\n" + "\n".join(mixed(64) for _ in range(int(rng.integers(2, 20)))) + f"\n-----END {block}", f"eyJ{mixed(20)}.eyJ{mixed(60)}.{mixed(43)}"])
            out.append({"value": value, "before": pick([pick(words) + " ", "\n", "key: ", ""]), "after": pick(["\n", " ", "", '"']), "path": pick(paths), "label": 1})
            continue
        good, kind = rng.random() < 0.5, int(rng.integers(4))
        opening = pick([' = "', "=", ": ", " = '", ': "', " = "])
        before = pick(words) + " " + pick(names) + opening
        if good and kind == 0:
            value, before = pick(["AKIA" + chars(upper + "234567", 16), "AKIA" + chars(upper, 16), "ghp_" + chars(lower + upper, 36), "glpat-" + chars(lower + upper, 20)]), pick([before, pick(words) + " "])
        elif good and kind == 1:
            value = chars(lower + upper, int(rng.integers(16, 40)))
        elif good:
            value = shuffled(chars(lower, int(rng.integers(2, 8))) + chars(upper, int(rng.integers(1, 4))) + chars(digits, int(rng.integers(1, 5))) + chars(marks, int(rng.integers(1, 4))))
        elif kind == 0:
            value, before = pick(["sk-learn", "sk-image", "sk-" + pick(words)]), pick([pick(words) + " ", before])
        elif kind == 1:
            value = pick(phrases)
        else:
            value = pick([pick(words), pick(words).title(), f"{pick(words)} {pick(words)} {pick(words)}", chars(digits, int(rng.integers(1, 6))), f"{pick(words)}_{pick(words)}"])
        quoted = before.endswith(('"', "'"))
        out.append({"value": value, "before": before, "after": before[-1] + pick([" ", "\n", ","]) if quoted else pick(["(", "[", " "] if value in ("getpass", "get_token", "os.environ", "request.headers") else [" ", "\n", "", ", ", "."]), "path": pick(paths), "label": int(good)})
    return out


def _grow(x: np.ndarray, y: np.ndarray, rng, cuts: list[np.ndarray], nodes: list, depth: int) -> int:
    me = len(nodes)
    nodes.append([-1, 0.0, me, me, float(y.mean())])
    if depth == 0 or len(y) < 8 or y.min() == y.max():
        return me
    best = (1e-9, -1, 0.0)
    total, n = y.sum(), len(y)
    impurity = lambda ones, count: ones * (1 - ones / np.maximum(count, 1))
    for j in rng.choice(x.shape[1], 6, replace=False):
        at = np.searchsorted(cuts[j], x[:, j], side="left")
        c = np.bincount(at, minlength=len(cuts[j]) + 1).cumsum()[:-1]
        o = np.bincount(at, y, len(cuts[j]) + 1).cumsum()[:-1]
        gain = np.where((c >= 3) & (n - c >= 3), impurity(total, n) - impurity(o, c) - impurity(total - o, n - c), 0)
        if len(gain) and gain.max() > best[0]:
            best = (float(gain.max()), int(j), float(cuts[j][gain.argmax()]))
    if best[1] < 0:
        return me
    left = x[:, best[1]] <= best[2]
    nodes[me][:2] = best[1:]
    nodes[me][2] = _grow(x[left], y[left], rng, cuts, nodes, depth - 1)
    nodes[me][3] = _grow(x[~left], y[~left], rng, cuts, nodes, depth - 1)
    return me


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> dict[str, list]:
    """Bagged trees with a random choice of features at each node, in flat arrays."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 24), method="lower")) for j in range(x.shape[1])]
    nodes: list = []
    roots = []
    for _ in range(trees):
        draw = rng.integers(0, len(y), len(y))
        roots.append(_grow(x[draw], y[draw], rng, cuts, nodes, depth))
    feature, cut, left, right, share = (list(c) for c in zip(*nodes, strict=True))
    return {"roots": roots, "feature": feature, "cut": cut, "left": left, "right": right, "share": share}


_forests: dict[str, dict] = {}


def train(spark: SparkSession, labelled: DataFrame | None = None) -> dict[str, list]:
    """A forest from labelled findings (the made ones by default); rows with nulls teach nothing, and without rows nothing is a secret."""
    if labelled is None and "made" in _forests:
        return _forests["made"]
    rows = labelled
    if labelled is None:
        kind = "array<struct<value: string, before: string, after: string, path: string, label: int>>"
        rows = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(labelled_findings() + assigned_findings())), kind)))
    # equal rows in whatever order and number of partitions give an equal forest
    got = rows.dropna(subset=["value", "before", "after", "path", "label"]).select(features(*(F.col(c) for c in ("value", "before", "after", "path"))).alias("x"), F.col("label").cast("double").alias("y")).orderBy(F.xxhash64("value", "before"), "y").limit(MOST_LABELLED).collect()
    if not got:
        return {"roots": [0], "feature": [-1], "cut": [0.0], "left": [0], "right": [0], "share": [0.0]}
    x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got])
    order = np.lexsort((*x.T, y))
    forest = grow_forest(x[order], y[order])
    if labelled is None:
        _forests["made"] = forest
    return forest


def _constant(values: list, kind: str) -> Column:
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def forest_score(x: Column, forest: dict[str, list]) -> Column:
    """The mean share of positives in the leaves that x reaches."""
    feature, left, right = (_constant(forest[k], "int") for k in ("feature", "left", "right"))
    cut, share = (_constant(forest[k], "double") for k in ("cut", "share"))

    def step(node: Column, _: Column) -> Column:
        return F.when(F.get(feature, node) < 0, node).when(F.get(x, F.get(feature, node)) <= F.get(cut, node), F.get(left, node)).otherwise(F.get(right, node))

    def leaf(total: Column, root: Column) -> Column:
        return total + F.get(share, F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), root, step))

    return F.aggregate(_constant(forest["roots"], "int"), F.lit(0.0), leaf) / F.lit(float(len(forest["roots"])))


def scan(docs: DataFrame, forest: dict[str, list] | None = None, text_col: str = "text", path_col: str | None = "source", keep: list[str] | None = None, threshold: float = THRESHOLD, found_as: str = "_tessera_found") -> DataFrame:
    """The ``keep`` columns of ``docs`` and a struct ``found_as``, whose name none of them may have.

    It holds n_candidates; findings (start in characters, length, score, sha256 of the value); redacted, the text with findings masked.
    """
    spark = docs.sparkSession
    forest = forest or train(spark)
    keep = docs.columns if keep is None else keep
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    path = F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")) if path_col else F.lit("")
    pattern = F.lit(CANDIDATE)
    # matches of the last part of the pattern alone need the length
    known = lambda t: (F.length(t) >= LEAST) | t.rlike(f"^{_KNOWN}")
    asked = rf"(?:{_ASKED})"
    kept = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_row") if keep else F.lit(None).alias("_row")
    one = docs.select(kept, text.alias("_text"), path.alias("_path"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("_tokens"))
    two = one.withColumn("_gaps", F.when(F.exists("_tokens", known) | ((F.size("_tokens") > 0) & F.col("_text").rlike(asked)), F.split("_text", CANDIDATE, -1)))
    token, gap = (lambda i: F.get("_tokens", i)), (lambda i: F.get("_gaps", i))
    before = lambda i: F.right(F.concat(F.coalesce(token(i - 1), F.lit("")), gap(i)), F.lit(48))
    which = F.filter(F.sequence(F.lit(0), F.size("_tokens") - 1), lambda i: known(token(i)) | before(i).rlike(f"{asked}$"))
    describe = lambda i: F.struct(i.alias("i"), token(i).alias("value"), before(i).alias("before"), F.left(gap(i + 1), F.lit(16)).alias("after"))
    three = two.withColumn("_candidates", F.when(F.col("_gaps").isNotNull(), F.transform(which, describe)))
    four = three.withColumn("_inputs", F.transform("_candidates", lambda c: F.struct(c["i"].alias("i"), features(c["value"], c["before"], c["after"], F.col("_path")).alias("x"))))
    five = four.withColumn("_bad", F.filter(F.transform("_inputs", lambda c: F.struct(c["i"].alias("i"), forest_score(c["x"], forest).alias("score"))), lambda c: c["score"] >= threshold))

    def start(i: Column) -> Column:
        total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + F.length(x))
        return total(F.slice("_gaps", F.lit(1), i + 1)) + total(F.slice("_tokens", F.lit(1), i))

    report = F.transform("_bad", lambda b: F.struct(start(b["i"]).alias("start"), F.length(token(b["i"])).alias("length"), b["score"].alias("score"), F.sha2(token(b["i"]), 256).alias("sha256")))
    places = F.transform("_bad", lambda b: b["i"])
    masked = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.size("_tokens") - 1), lambda i: F.concat(gap(i), F.when(F.array_contains(places, i), F.lit(MARK)).otherwise(token(i)))), ""), gap(F.size("_tokens")))
    found = F.struct(
        F.coalesce(F.size("_candidates"), F.lit(0)).cast("long").alias("n_candidates"),
        F.coalesce(report, F.array().cast("array<struct<start: int, length: int, score: double, sha256: string>>")).alias("findings"),
        F.when(F.coalesce(F.size("_bad"), F.lit(0)) > 0, masked).alias("redacted"),
    ).alias(found_as)
    # two steps: within one, a kept column would hide an inner one of its name
    return five.select("_row", found).select(*(F.col("_row")[c].alias(c) for c in keep), F.col(f"`{found_as}`"))


def redact(docs: DataFrame, forest: dict[str, list] | None = None, text_col: str = "text", path_col: str | None = "source", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` with secrets masked in the text, and its length brought up to date."""
    found = scratch.free_name(docs.columns, "_tessera_found")
    done = scan(docs, forest, text_col, path_col, found_as=found)
    redacted = F.col(f"{found}.redacted")
    out = {text_col: F.coalesce(redacted, F.col(f"`{text_col}`"))}
    if length_col and length_col in docs.columns:
        out[length_col] = F.when(redacted.isNotNull(), F.length(redacted).cast(docs.schema[length_col].dataType)).otherwise(F.col(f"`{length_col}`"))
    return done.select(*(out.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
