"""Secret scan whose candidates a random forest confirms.

Candidates are runs of the characters that keys are written in, whatever follows
a word such as ``password`` and an assignment (to the end of the word, or of the
quotes), and passwords in addresses. A forest decides which are secrets from their
length, the transitions between their characters, how much of them dictionary
words cover, whether they look like a path, host, number, date or stand-in, and
the words beside them. The dictionary is what the corpus itself uses often
(``frequent_words``). The forest is trained from labelled findings: rows of
``(text, start, end, label)``, whose candidates it sees as a scan would.
``labelled_findings`` writes such rows from a seed: keys of common shapes and
passwords beside the words that announce them, and what scans wrongly report
(hashes of commits and files, identifiers, addresses, hosts, paths, versions, long
words, stand-ins, prose behind a colon).

What the gate leaves out: values of under four characters, and runs of under
twelve without an announcing word, or without a digit unless long and of mixed
case.

Defined results: null and empty texts have no findings; repeated rows are
scanned each; of candidates that overlap the first, then the longer one counts;
places count characters; a redacted text is otherwise unchanged.
"""

from __future__ import annotations

import math
import random
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .batches import map_columns
from .scratch import Scratch

RUN = re.compile(r"(?<![A-Za-z0-9+/_.~-])[A-Za-z0-9+/_.~-]{12,}(?:={1,2}(?![A-Za-z0-9+/_.~=-]))?")
_NAMES = r"passw(?:or)?d|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth|bearer"
ANNOUNCED = re.compile(rf"(?:{_NAMES})[A-Za-z0-9_]{{0,20}}[\"'`]?\s{{0,8}}(?:=>|:=|[=:])\s{{0,8}}(?:\"([^\"\n]+)\"|'([^'\n]+)'|`([^`\n]+)`|([^\s\"'`,;<>(){{}}]+))", re.I)
USERINFO = re.compile(r"://[^\s/:@]+:([^\s/@]+)@")
_KEY = re.compile(r"secret|token|passw|passphrase|pwd|api|key|auth|bearer|credential|private", re.I)
_PASSWORD = re.compile(r"passw|passphrase|pwd", re.I)
_INNOCENT = re.compile(r"commit|sha|md5|hash|digest|checksum|uuid|guid|build|version|revision|etag|trace|request|file|path|host|mail|http|image|integrity", re.I)
_STANDIN = re.compile(r"^(?:none|null|nil|true|false|yes|no|required|optional|unset|empty|todo|tbd|n/a|string|str|text|hidden|redacted|change_?me|your[_-].*|my[_-].*|example.*|x{3,}|\*+|\.{3,}|<.*>|\[.*\]|\$\{?.*|%.*%|\{\{.*|(?:os|process|sys|config|settings|env|self|args|request)[.\[(].*)$", re.I)
_WORD = re.compile(r"[A-Za-z]{3,}")
_TAIL = re.compile(r"([\w-]*)[\"'`]?\s*(=>|:=|[=:])?\s*[\"'`]?$")
THRESHOLD, MARK = 0.5, "<secret>"
TREES, DEPTH, SEED = 40, 10, 23
#: Shortest value that an announcing word makes a candidate; words of the dictionary, and how often each must occur.
MIN_VALUE, WORDS, MIN_COUNT = 4, 20_000, 5

#: Beginnings that well-known key formats have.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk_test_", "rk_live_", "AIza", "ya29.", "eyJ", "SG.", "npm_", "pypi-")

#: Words around secrets, hosts and code that a corpus of prose may lack.
COMMON = frozenset("""example mail com org net www http https index html file path user home data config test main master default local
    host server client static image content version release build package module class function return value name type
    string number object array list table column admin login session request response error message document page
    report summary result output input source target password secret token key private public access account service""".split())


def frequent_words(docs: DataFrame, most: int = WORDS, least: int = MIN_COUNT) -> frozenset[str]:
    """The most frequent words of three letters or more over all texts, and ``COMMON``.

    Frequencies are taken in steps of a sixteenth of a doubling, and a step's words
    come all or not at all, as long as ``most`` hold them: so the driver sees one row
    a step and the words that are kept, however many tasks counted.
    """
    scratch = Scratch(docs.sparkSession, "words")
    each = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("length(word) between 3 and 24")
    counts = scratch.save(each.groupBy("word").count().where(F.col("count") >= least))
    step = F.floor(F.log2("count") * 16).alias("step")
    sizes = counts.groupBy(step).agg(F.count(F.lit(1)).alias("n")).collect()
    taken, lowest = 0, None
    for r in sorted(sizes, key=lambda r: -r["step"]):
        taken += r["n"]
        if taken > most:
            break
        lowest = r["step"]
    found = counts.where(step >= lowest).select("word").collect() if lowest is not None else []
    scratch.drop(counts)
    return COMMON | {r["word"] for r in found}


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def covered(token: str, known: frozenset[str] = COMMON) -> float:
    """Share of a token's letters that belong to dictionary words, or to runs of letters that read like words."""
    total = 0
    letters = sum(c.isalpha() for c in token)
    for m in _WORD.finditer(token.lower()):
        run = m[0]
        if run in known:
            total += len(run)
            continue
        vowels = sum(c in "aeiouy" for c in run)
        if len(run) >= 5 and 0.2 <= vowels / len(run) <= 0.65:
            total += len(run)
    return total / letters if letters else 0.0


def features(text: str, start: int, end: int, known: frozenset[str] = COMMON) -> list[float]:
    t = text[start:end]
    n = len(t)
    kinds = [_kind(c) for c in t]
    counts = [kinds.count(k) / n for k in range(4)]
    steps = [[0] * 4 for _ in range(4)]
    for a, b in zip(kinds, kinds[1:], strict=False):
        steps[a][b] += 1
    freq = {c: t.count(c) for c in set(t)}
    entropy = -sum(v / n * math.log2(v / n) for v in freq.values())
    before = text[max(0, start - 40):start]
    tail = _TAIL.search(before)
    name, assign = (tail[1], tail[2]) if tail else ("", None)
    near = before.split()[-3:]
    after = text[end:end + 1]
    low = t.lower()
    dots = t.split(".")
    return [
        n, entropy, entropy / math.log2(max(n, 2)), *counts, *(steps[a][b] / max(1, n - 1) for a in range(4) for b in range(4)),
        covered(t, known), float(low in known), max((len(r) for r in re.findall(r"[A-Za-z]+", t)), default=0), max((len(r) for r in re.findall(r"\d+", t)), default=0),
        t.count("/"), t.count("."), t.count("-"), t.count("_"), float(t.endswith("=")),
        float(all(c in "0123456789abcdef" for c in low)), float(bool(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", low))),
        float(all(p.isdigit() for p in dots)), float(bool(re.search(r"\.[a-z]{2,4}$", low))), float(t.startswith("/") or "://" in t or "./" in t),
        float(before.endswith("@")), float(after == "@"), float(t.startswith(PREFIXES)),
        float(assign is not None or before.endswith(("=", "='", '="'))), float(bool(_KEY.search(name)) or any(_KEY.search(w) for w in near)),
        float(bool(_INNOCENT.search(name)) or any(_INNOCENT.search(w) for w in near)), float(before[-1:] in "\"'`" and before != ""), float(after in ("\"", "'", "`")),
        float(bool(_STANDIN.match(t))), float(bool(_PASSWORD.search(name))), float(assign in ("=", ":=", "=>")), float(t.count(" ")),
        float(before.endswith(":") and after == "@"), float(sum(not c.isalnum() for c in t)), float(after == "("),
    ]


class Forest:
    """Trees over features, each as arrays of splits and leaf shares."""

    def __init__(self, known: frozenset[str] = COMMON) -> None:
        self.known = known
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
        rng = np.random.default_rng(seed)
        tries = max(1, int(np.sqrt(x.shape[1])))
        for _ in range(trees):
            take = rng.integers(0, len(x), len(x))
            nodes: list[list[float]] = []

            def grow(rows: np.ndarray, level: int) -> int:
                at, share = len(nodes), float(y[rows].mean())
                nodes.append([-1, 0.0, -1, share])
                if level == depth or len(rows) < 4 or share in (0.0, 1.0):
                    return at
                best = (2.0, -1, 0.0)
                for f in rng.permutation(x.shape[1])[:tries]:
                    v = np.sort(x[rows, f])
                    cuts = np.unique((v[1:] + v[:-1])[v[1:] != v[:-1]] / 2)
                    for c in cuts[np.linspace(0, len(cuts) - 1, min(len(cuts), 12)).astype(int)] if len(cuts) else []:
                        left = x[rows, f] <= c
                        if left.all() or not left.any():  # neighbours so close that their mean is one of them
                            continue
                        p, q, w = y[rows][left].mean(), y[rows][~left].mean(), left.mean()
                        gini = w * p * (1 - p) + (1 - w) * q * (1 - q)
                        if gini < best[0]:
                            best = (gini, int(f), float(c))
                if best[1] < 0:
                    return at
                left = x[rows, best[1]] <= best[2]
                nodes[at][:2] = [best[1], best[2]]
                grow(rows[left], level + 1)  # the left child follows its parent
                nodes[at][2] = grow(rows[~left], level + 1)
                return at

            grow(take, 0)
            a = np.asarray(nodes)
            self.trees.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3]))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets in the leaves that rows end in."""
        total = np.zeros(len(x))
        for feature, cut, right, share in self.trees:
            at = np.zeros(len(x), dtype=int)
            while True:
                on = np.flatnonzero(feature[at] >= 0)
                if not len(on):
                    break
                f = feature[at[on]]
                at[on] = np.where(x[on, f] <= cut[at[on]], at[on] + 1, right[at[on]])
            total += share[at]
        return total / max(1, len(self.trees))


def labelled_findings(n: int = 6000, seed: int = SEED, known: frozenset[str] = COMMON) -> list[tuple[str, int, int, int]]:
    """``(text, start, end, label)`` rows of secrets (1) and of what is not one (0), with prose from the dictionary."""
    rng = random.Random(seed)
    hexa, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    syllables = "the ing er on an re ed st or ti es at en ou in de la que ch ung lich ver tion ment os ra ci do".split()
    vocabulary = sorted(known)
    word = lambda a=1, b=5: rng.choice(vocabulary) if rng.random() < 0.5 else "".join(rng.choice(syllables) for _ in range(rng.randint(a, b)))
    leet = lambda w: "".join({"a": "4", "e": "3", "i": "1", "o": "0", "s": "5"}.get(c, c) if rng.random() < 0.5 else c for c in w)
    long_word = lambda: next(w for w in iter(lambda: word(2, 5), None) if len(w) >= 4)
    passwords = [
        lambda: long_word() + pick("0123456789", rng.randint(1, 4)), lambda: leet(long_word()).capitalize() + rng.choice("&!#$%*+?@") + pick("0123456789", rng.randint(1, 3)),
        lambda: "".join(long_word() for _ in range(rng.randint(3, 5))), lambda: "-".join(long_word() for _ in range(rng.randint(4, 5))), lambda: pick(mixed + "!#$%&*+?_-", rng.randint(7, 18)),
        lambda: long_word().capitalize() + rng.choice("!#$%*") + pick("0123456789", 2) + long_word(), lambda: pick(mixed, rng.randint(6, 11)),
    ]
    password_names = ["password", "passwd", "pwd", "db_password", "PASSWORD", "user_pwd", "passphrase", "Password", "admin_password", "secret", "client_secret"]
    standins = ["none", "null", "true", "required", "optional", "your_password", "your-token", "changeme", "********", "${DB_PASSWORD}", "<password>", "os.environ", "process.env.SECRET", "getpass", "example",
                "xxxxxxxx", "string", "{{ secret }}", "settings.SECRET_KEY", "hidden", "%PASSWORD%", "[redacted]", "config.token", "n/a", "request.token", "self.password", "args.token"]
    key_names = ["password", "secret", "token", "api_key", "auth", "bearer", "credentials", "private_key", "passphrase"]
    secrets = [
        lambda: pick(hexa, rng.choice([32, 40, 48, 64])), lambda: pick(mixed, rng.randint(20, 48)), lambda: pick(mixed + "+/", 40) + rng.choice(["", "=", "=="]),
        lambda: "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda: "ghp_" + pick(mixed, 36), lambda: "xoxb-" + pick("0123456789", 12) + "-" + pick(mixed, 24),
        lambda: "sk_live_" + pick(mixed, 24), lambda: "eyJ" + pick(mixed, 30) + "." + pick(mixed, 40) + "." + pick(mixed + "_-", 43),
        lambda: pick(mixed, 8) + "-" + pick(mixed, 12) + rng.choice("_-") + pick(mixed, 6),
    ]
    names = ["token", "secret", "api_key", "apikey", "password", "passwd", "auth_token", "access_key", "client_secret", "private_key", "AUTH", "bearer", "credentials"]
    innocent = [
        (lambda: pick(hexa, 40), ["commit", "sha1", "revision", "tree", "parent", "blob"]), (lambda: pick(hexa, rng.choice([32, 64])), ["md5", "sha256", "checksum", "digest", "etag"]),
        (lambda: "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), ["id", "uuid", "request", "trace", ""]), (lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), ["", "host", "from", word()]),
        (lambda: f"{rng.choice(['mail', 'www', 'cdn', 'db'])}{rng.randint(1, 99)}.example.{rng.choice(['com', 'org', 'net'])}", ["@", "host", "at", ""]),
        (lambda: pick("0123456789", rng.randint(12, 19)), ["", "no", "order", word(), "account"]), (lambda: "/".join(word(1, 3) for _ in range(rng.randint(2, 5))) + rng.choice([".txt", ".py", "", "/index.html"]), ["path", "file", "see", ""]),
        (lambda: f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}T{rng.randint(0, 23):02d}.{rng.randint(0, 59):02d}", ["at", "date", ""]),
        (lambda: word(4, 10), [word(), word(), "the", ""]), (lambda: "-".join(word(1, 3) for _ in range(rng.randint(3, 5))), ["", "the", "a"]), (lambda: "_".join(word(1, 3) for _ in range(rng.randint(2, 5))) + rng.choice(["", "1", "_v2"]), ["def", "call", "name"]),
        (lambda: word(1, 3) + "." + pick("0123456789", 2) + "@", [""]), (lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 99)}-beta.{rng.randint(1, 9)}+{pick(hexa, 7)}", ["version", "release", ""]),
        (lambda: rng.choice(["=" * 20, "-" * 24, "_" * 16, "." * 14]), [""]), (lambda: word(4, 8).upper(), [word().upper(), ""]), (lambda: "data:image/png;base64,"[-12:] + pick(mixed, 30), ["image", "src"]),
    ]
    out = []
    for i in range(n):
        prose = lambda k: " ".join(word() for _ in range(rng.randint(0, k)))
        junk = rng.choice(["", "", "", " ", ".", ",", "!!", "***", "###", "\n"])
        kind = i % 4
        if kind == 1:
            token, label = rng.choice(secrets)(), 1
            name, (open_, close) = rng.choice(names), rng.choice([('"', '"'), ("'", "'"), ("", ""), ('"', '"')])
            lead = name + rng.choice([" = ", "=", ": ", " : ", " ", " := "]) + open_
            if rng.random() < 0.1 and token.startswith(PREFIXES):
                lead, close = "", ""
        elif kind == 3 and i % 8 == 3:
            token, label = rng.choice(passwords)(), 1
            if rng.random() < 0.2:
                token = token.replace("@", "x").replace("/", "x")
                lead, close, junk = rng.choice(["postgres", "mysql", "https", "amqp", "redis"]) + "://" + word(1, 2) + ":", "@" + word(1, 3) + rng.choice([".example.com", ":5432/db", ""]), " "
            else:
                open_ = rng.choice(['"', "'", "", '"'])
                lead, close = rng.choice(password_names) + rng.choice(['" : ', " = ", "=", ": ", " := "]) + open_, open_
                junk = junk if open_ else rng.choice(["", " ", "\n"])
        elif kind == 3:  # an announcing word, and no secret behind it
            label, close, name = 0, "", rng.choice(key_names)
            form = rng.random()
            if form < 0.4:
                token, close = rng.choice([str, str, str.capitalize, str.upper])(rng.choice(standins)), rng.choice(["", '"'])
                lead = name + rng.choice([" = ", "=", ": "]) + ('"' if close else "")
                if rng.random() < 0.15:
                    lead, token, close = rng.choice(["Authorization: ", "authorization: ", "auth: ", "WWW-Authenticate: "]), rng.choice(["Bearer", "Basic", "Digest", "bearer", "Token"]), ""
            elif form < 0.8:
                token, lead = long_word(), word() + " " + name + rng.choice([": ", " : "])
                junk = " " + prose(6)
            else:
                token, lead, close = " ".join(word() for _ in range(rng.randint(2, 6))), name + ': "', '"'
        else:
            make, before = rng.choice(innocent)
            token, label, close = make(), 0, rng.choice(["", "", "", '"'])
            name = rng.choice(before)
            lead = name if name == "@" else name + rng.choice([" ", " ", ": ", "="]) + ('"' if close else "") if name else ""
        left = prose(8)
        left = left + " " + lead if left and lead != "@" else left + lead
        text = left + token + close + junk + (" " + prose(8) if junk != "\n" else prose(8))
        if rng.random() < 0.15:
            text = text.upper()
        out.append((text, len(left), len(left) + len(token), label))
    return out


def train(findings: list[tuple[str, int, int, int]], known: frozenset[str] = COMMON) -> Forest:
    """A forest from labelled findings, each as the candidate that a scan would make of it; with none, nothing is confirmed."""
    if not findings:
        return Forest(known)
    x, y = [], []
    for t, a, b, label in findings:
        met = [(i, j) for i, j in candidates(t) if i < b and a < j]
        for i, j in met or [(a, b)]:
            x.append(features(t, i, j, known))
            y.append(label if (i, j) == (a, b) or not met or min(j, b) - max(i, a) > (b - a) / 2 else 0)
    return Forest(known).fit(np.asarray(x), np.asarray(y, dtype=float))


def candidates(text: str | None) -> list[tuple[int, int]]:
    """Places of runs that hold a digit, or that are long and mix cases; of announced values; and of passwords in addresses."""
    text, spans = text or "", []
    for m in RUN.finditer(text):
        t = m[0].rstrip(".-=" if m[0].endswith((".", "-")) else ".-")
        if len(t) >= 12 and (any(c.isdigit() for c in t) or (len(t) >= 20 and re.search(r"[a-z][A-Z].*[a-z][A-Z]", t))):
            spans.append((m.start(), m.start() + len(t)))
    for m in ANNOUNCED.finditer(text):
        g = m.lastindex or 4
        a, b = m.span(g)
        b -= len(m[g]) - len(m[g].rstrip(".:!?*#" if set(m[g]) - set("*#.:!?") else "")) if g == 4 else 0
        if b - a >= MIN_VALUE:
            spans.append((a, b))
    if "://" in text:
        spans += [m.span(1) for m in USERINFO.finditer(text) if len(m[1]) >= MIN_VALUE]
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans), key=lambda s: (s[0], -s[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def scan_texts(texts: list[str | None], forest: Forest) -> list[list[tuple[int, int, float]]]:
    """``(start, end, score)`` of every candidate of each text."""
    places = [candidates(t) for t in texts]
    flat = [features(texts[i], a, b, forest.known) for i, p in enumerate(places) for a, b in p]
    score = iter(forest.score(np.asarray(flat)).tolist() if flat else [])
    return [[(a, b, next(score)) for a, b in p] for p in places]


def learned(docs: DataFrame) -> Forest:
    """The forest of the seeded findings, with the dictionary of all texts of ``docs``."""
    known = frequent_words(docs)
    return train(labelled_findings(known=known), known)


def scan(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, text, findings`` of every row: the text with its secrets replaced, and all candidates with their scores."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(doc_id: list, text: list) -> dict:
        found = scan_texts(text, shared.value)
        clean = []
        for t, fs in zip(text, found, strict=True):
            for a, b, s in reversed(fs):
                if s >= threshold:
                    t = t[:a] + MARK + t[b:]
            clean.append(t)
        rows = [[{"start": a, "end": b, "score": s, "secret": s >= threshold, "value": t[a:b]} for a, b, s in fs] for t, fs in zip(text, found, strict=True)]
        return {"doc_id": doc_id, "text": clean, "findings": rows}

    return map_columns(docs.select(F.col("doc_id").cast("long"), "text"),
                       "doc_id long, text string, findings array<struct<start: int, end: int, score: double, secret: boolean, value: string>>", run)
