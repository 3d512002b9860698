"""Secret scan: candidate strings judged by a random forest trained on labelled findings."""

from __future__ import annotations

import base64
import functools
import hashlib
import math
import random
import re
import string
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, raw

#: A private key from its first to its last line, or to the end of the text.
KEY_BLOCK = re.compile(rb"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:[^-]|-(?!----END))*(?:-----END [A-Z0-9 ]{0,40}-----|\Z)")
#: A candidate: a run of key characters, of length 12 at least with a digit or of 20 at least without.
CANDIDATE = re.compile(rb"[A-Za-z0-9_\-+/=.@%~]{12,}")
SPLIT = re.compile(rb"^[A-Za-z_][A-Za-z_.\-]{1,30}[=]{1,2}(?=[^=])")
#: Assignment signs; names and words of secrets, after which a whole value is a candidate from SHORTEST on.
SIGN = re.compile(rb"(?:=>|:=|=+|:(?!//))[ \t]*")
NAME = re.compile(rb"[\w.\-]+[\"'\])]*[ \t]*\Z")
SECRET_NAME = re.compile(rb"(?:pass(?:word|wd|phrase|code)\w*|pwd|secret\w*|token|credentials?|(?:api|access|private|secret|signing|client|auth|aws|encryption)[_\-.]?key|auth|authorization|bearer)[\"'\])]*[ \t]*\Z", re.I)
SECRET_WORD = re.compile(rb"(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_\-]?key|bearer|credentials?)[ \t]+(?:(?:is|was)[ \t]+)?(?=[^\s=:])", re.I)
QUOTED = re.compile(rb"\"((?:[^\"\\\r\n]|\\.)*)\"|'((?:[^'\\\r\n]|\\.)*)'")
UNQUOTED = re.compile(rb"\S+")
SHORTEST = 6
#: What stands for a value but is none: stand-ins by their words or marks, and code.
STAND_IN = re.compile(rb"change_?me|your|example|placeholder|insert|dummy|x{4,}|\*{3,}|\.{3}|test_|_here|0{6,}|\A(?:bearer|basic|none|null|undefined|required|optional|string|password|secret|token|hidden|redacted|false|true)\W*\Z", re.I)
CODE = re.compile(rb"\A[$<{(\[%]|\w[(\[]|\A(?:os|self|process|env|config|settings|args|request|this)\.|://")
#: Words near a candidate that tell of a secret, or of something else. Fixed values.
SECRET_WORDS = frozenset(b"password passwd pwd secret token apikey api key auth authorization bearer credential credentials private access aws client signing".split())
OTHER_WORDS = frozenset(b"sha commit hash checksum md5 sha256 etag revision uuid guid id example sample placeholder test dummy fixture email mail card image data version".split())
PREFIXES = (b"AKIA", b"ASIA", b"ghp_", b"gho_", b"github_pat_", b"sk_live_", b"rk_live_", b"xoxb-", b"xoxp-", b"AIza", b"glpat-", b"eyJ", b"npm_", b"SG.", b"-----BEGIN")
FEATURES = ("length", "entropy", "transition", "digit_share", "upper_share", "lower_share", "other_share", "class_changes", "hex_only", "dictionary", "repeats", "known_prefix", "assigned", "quoted", "secret_words", "other_words", "has_at", "dots", "uuid_form", "path_code", "path_test", "digits_only", "secret_name", "stand_in", "code", "spaces")
#: Vowel-bearing letter pairs and ends usual in words of many languages; they make up dictionary coverage with the words of the text itself.
COMMON_PARTS = tuple("the and ing ion ent her for tha nth int ere tio ver ter est ers ati hat ate all eth hes ver his oft ith fth sth oth res ont you are not but was ess ist com con pro der sch ein ich und die che gen que les des eur ait men con est ado los las par ent".split())
WINDOW = 48


def _classes(text: bytes) -> np.ndarray:
    return _CLASS[np.frombuffer(text, np.uint8)]


_CLASS = np.array([0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 for b in range(256)], np.int8)


@functools.cache
def _transitions() -> np.ndarray:
    """Log-likelihood ratio of letter pairs: word-like text against uniformly drawn letters."""
    counts = np.full((26, 26), 0.5)
    words = "identifier configuration number example application service directory repository version parameter function database password document language processing information management development environment controller message response request network connection interface component container" + " " + " ".join(COMMON_PARTS)
    for w in words.split():
        for a, b in zip(w, w[1:]):
            if a.isalpha() and b.isalpha():
                counts[ord(a) - 97, ord(b) - 97] += 1
    return np.log(counts / counts.sum() * 676)


def features(value: bytes, before: bytes, after: bytes, path: str) -> list[float]:
    """The numbers by which the forest judges a candidate."""
    n, kinds = len(value), _classes(value)
    counts = np.bincount(np.frombuffer(value, np.uint8), minlength=256)
    p = counts[counts > 0] / n
    low = np.frombuffer(value.lower(), np.uint8).astype(np.int64) - 97
    letters = (low >= 0) & (low < 26)
    pairs = letters[1:] & letters[:-1]
    transition = float(_transitions()[low[:-1][pairs], low[1:][pairs]].mean()) if pairs.any() else -1.0
    lower = value.lower().decode("latin-1")
    covered = sum(lower.count(x) * len(x) for x in COMMON_PARTS) / n
    near = re.findall(rb"[a-z0-9]+", (before[-WINDOW:] + b" " + after[:WINDOW]).lower())
    last = before[-24:].rstrip(b" \"'")
    folder = path.lower()
    return [
        min(n, 200),
        float(-(p * np.log2(p)).sum()),
        transition,
        *(float((kinds == k).mean()) for k in (2, 1, 0, 3)),
        float((kinds[1:] != kinds[:-1]).mean()) if n > 1 else 0.0,
        float(re.fullmatch(rb"[0-9a-fA-F]+", value) is not None),
        min(covered, 2.0),
        float((counts.max()) / n),
        float(value.startswith(PREFIXES)),
        float(last.endswith((b"=", b":"))),
        float(before[-1:] in (b'"', b"'") and after[:1] in (b'"', b"'")),
        float(sum(w in SECRET_WORDS for w in near)),
        float(sum(w in OTHER_WORDS for w in near)),
        float(b"@" in value),
        float(min(value.count(b"."), 9)),
        float(re.fullmatch(rb"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value) is not None),
        float(re.search(r"\.(py|js|ts|go|java|rb|env|ya?ml|json|toml|ini|conf|sh)$", folder) is not None),
        float(re.search(r"test|spec|fixture|example|mock|sample", folder) is not None),
        float((kinds == 2).all()),
        float(SECRET_NAME.search(re.sub(rb"[=:>]+[ \t]*[\"']?\Z", b"", before[-WINDOW:])) is not None and last.endswith((b"=", b":", b"=>"))),
        float(STAND_IN.search(value) is not None),
        float(CODE.search(value) is not None),
        float(min(value.count(b" "), 9)),
    ]


def _runs(text: bytes) -> list[tuple[int, int]]:
    """[start, end) of runs of key characters. A name with an equals sign ahead is cut off."""
    out = []
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        if head := SPLIT.match(text[s:e]):
            s += head.end()
        value = text[s:e]
        while e > s and text[e - 1 : e] in (b".", b"-", b"_", b"/", b"+", b"%", b"~"):
            e -= 1
        value = text[s:e]
        if len(value) >= 12 and (len(value) >= 20 or any(48 <= c <= 57 for c in value)):
            out.append((s, e))
    return out


def _values(text: bytes) -> list[tuple[int, int]]:
    """[start, end) of whole values, quoted or up to white space, after assignments and secret words.

    Values of secret names are taken within other values too, the others only outside of values, so
    all values together are at most twice as long as the text.
    """
    heads = []
    for m in SIGN.finditer(text):
        tail = text[max(0, m.start() - 80) : m.start()]
        if name := NAME.search(tail):
            before = tail[: name.start()][-1:]
            heads.append((m.end(), SECRET_NAME.search(tail) is not None, before if before in (b'"', b"'") and name[0].strip().isascii() and not re.search(rb"[\"']", name[0]) else b""))
    heads += [(m.end(), True, b"") for m in SECRET_WORD.finditer(text)]
    out, taken = [], [0, 0]  # ends of values of other names, of secret names
    for at, secret, inside in sorted(heads):
        if at < taken[1] or not secret and at < taken[0]:
            continue
        if m := QUOTED.match(text, at):
            s, e = m.span(1) if m[1] is not None else m.span(2)
        else:
            s = at + (text[at : at + 1] in (b'"', b"'"))
            m = UNQUOTED.match(text, s)
            e = m.end() if m else s
            if inside and (cut := text.find(inside, s, e)) >= 0:
                e = cut
            while e > s and text[e - 1] in b"\"'`,;)]}>.":
                e -= 1
        taken[secret] = max(taken[secret], e)
        if e - s >= SHORTEST:
            out.append((s, e))
    return out


def candidates(text: bytes) -> list[tuple[int, int]]:
    """[start, end) of candidates in a text, in order; a run may stand within a whole value."""
    return sorted({*_runs(text), *_values(text), *((m.start(), m.end()) for m in KEY_BLOCK.finditer(text))})


def merged(spans: list) -> list[list[int]]:
    """Secrets found, in order, those that overlap as one."""
    out: list[list[int]] = []
    for s, e in spans:
        if out and s < out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def labelled_findings(n: int = 6000, seed: int = 11, without: int | None = None, only: int | None = None) -> tuple[list[list[float]], list[int]]:
    """Labelled findings made from public formats: live-looking secrets, and what scanners report wrongly.

    without, only: a format of secrets (by number) to leave out, or to take alone, for tests on formats that
    a forest was not fitted on."""
    r = random.Random(seed)
    draw = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    up, hexa, b64, alnum = string.ascii_uppercase + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits
    syllables = ["th", "er", "on", "an", "re", "in", "ed", "es", "ti", "en", "sch", "ein", "que", "ment", "ado", "ción", "tion", "ing", "ble", "ly", "ver"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    long_word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(5, 12)))
    common = "correct horse battery staple dragon monkey hunter summer winter shadow master sunshine flower river orange football coffee silver guitar purple london tiger".split()
    plain = lambda: "".join(r.choice(common) for _ in range(r.randint(1, 3))).ljust(6, "s")
    signs = "!#$&*^@%?+-_"
    leet = lambda: "".join({"o": "0", "e": "3", "a": "4", "i": "1"}.get(c, c) if r.random() < 0.5 else c for c in plain()).title()
    chosen = lambda: r.choice([lambda: plain() + draw(string.digits, r.randint(1, 4)) + r.choice(["", draw(string.ascii_lowercase + signs, r.randint(1, 2))]), lambda: leet() + draw(signs, r.randint(0, 2)) + draw(string.digits, r.randint(1, 3)), lambda: draw(alnum + signs, r.randint(8, 16)), lambda: draw(alnum, r.randint(6, 11))])()
    names = ["password", "passwd", "pwd", "db_password", "DB_PASSWORD", "secret", "client_secret", "passphrase", "token", "api_key"]
    forms = [("=", ""), (": ", ""), (" = \"", '"'), ("='", "'"), ("\": \"", '"'), (":", "")]

    def assigned(name: str, value: str) -> tuple[str, str, str]:
        sign, tail = r.choice(forms)
        return name + sign, value, tail

    fields = ["name", "title", "label", "user", "note", "type", "path", "lang", "author", "tokens", "color", "class", "model", "topic", "url", "see"]
    sentence = lambda: " ".join(word() for _ in range(r.randint(2, 9))).ljust(6, "s")
    stand_ins = ["changeme", "<password>", "${DB_PASSWORD}", 'os.environ["PW"', "get_password(", "required", "string", "undefined", "your-password", "********", "xxxxxxxx", "Bearer", "process.env.TOKEN", "example", "settings.SECRET", "{{ secret }}", "redacted", "self.password"]
    secret = [
        lambda: assigned(r.choice(names), chosen()),
        lambda: assigned(r.choice(names), chosen()),
        lambda: (r.choice(["password=", "pwd=", "secret=", 'password = "', "passphrase="]), plain() + r.choice(common), ""),
        lambda: (r.choice(["password ", "pwd ", "password is ", "secret ", "passphrase "]), chosen(), ""),
        lambda: ("", r.choice(["AKIA", "ASIA"]) + draw(up, 16), ""),
        lambda: (r.choice(["password=", "passwd: ", "pwd=", 'password = "', "db_password="]), draw(r.choice([hexa, alnum]), r.randint(12, 28)), r.choice(["", '"'])),
        lambda: (r.choice(['token = "', "token: ", "auth_token=", "Authorization: Bearer ", 'api_key="', "client_secret: "]), draw(r.choice([hexa, alnum, b64]), r.choice([32, 40, 48, 64])), r.choice(['"', "", "'"])),
        lambda: ("", r.choice(["ghp_", "gho_"]) + draw(alnum, 36), ""),
        lambda: (r.choice(["", "key: "]), r.choice(["sk_live_", "rk_live_"]) + draw(alnum, 24), ""),
        lambda: ("", "xoxb-" + draw(string.digits, 12) + "-" + draw(alnum, 24), ""),
        lambda: (r.choice(["aws_secret_access_key = ", "secret: "]), draw(b64, 40), ""),
        lambda: (r.choice(["jwt ", "Bearer "]), "eyJ" + draw(alnum, 30) + "." + "eyJ" + draw(alnum, 50) + "." + draw(alnum, 43), ""),
        lambda: ("", "-----BEGIN " + (kind := r.choice(["", "RSA ", "EC ", "OPENSSH "])) + "PRIVATE KEY-----\n" + "\n".join(draw(b64, 64) for _ in range(r.randint(1, 12))) + "\n" + draw(b64, r.randint(4, 64)) + f"\n-----END {kind}PRIVATE KEY-----", ""),
    ]
    secret = [f for i, f in enumerate(secret) if i != without and only in (None, i)]
    other = [
        lambda: assigned(r.choice(fields), r.choice([sentence, plain, word, chosen, long_word])().ljust(6, "s")),
        lambda: (r.choice(fields) + r.choice(['="', ': "']), sentence(), '"'),
        lambda: (word() + r.choice([": ", ":", " = "]), r.choice([plain, long_word, word])().ljust(6, "s"), ""),
        lambda: assigned(r.choice(names), r.choice(stand_ins)),
        lambda: (r.choice(["password ", "secret ", "token ", "credentials ", "api key ", "bearer "]), r.choice([plain, long_word, word])().ljust(6, "s"), r.choice(["", ".", ","])),
        lambda: (r.choice(["", "mail ", "write to "]), f"{draw(string.ascii_lowercase, r.randint(3, 9))}.{draw(string.digits, 2)}@{r.choice(['mail', 'post', 'web'])}{r.randint(1, 9)}.example.com", ""),
        lambda: (r.choice(["", "card "]), r.choice("45") + draw(string.digits, 15), ""),
        lambda: ("", "+" + draw(string.digits, 12), ""),
        lambda: (r.choice(["commit ", "sha ", "sha256:", "checksum ", "revision ", "etag: "]), draw(hexa, r.choice([32, 40, 64])), ""),
        lambda: (r.choice(["id ", "uuid=", "guid: ", ""]), str(uuid.UUID(int=r.getrandbits(128))), ""),
        lambda: ("", long_word(), ""),
        lambda: ("", long_word(), ""),
        lambda: ("", "_".join(word() for _ in range(r.randint(3, 6))) + str(r.randint(0, 99)), ""),
        lambda: ("", "https" + "/".join(word() for _ in range(r.randint(3, 6))) + str(r.randint(0, 999)), ""),
        lambda: (r.choice(["password=", 'token = "', "secret: ", "api_key="]), r.choice(["changeme", "your_", "example_", "xxxxxxxx", "placeholder_", "insert_", "dummy_", "test_"]) + r.choice(["token_here", "password_here", "xxxxxxxxxxxx", "value_123", "secret_key_1", "000000000000"]), r.choice(["", '"'])),
        lambda: ("data:image/png;base64,", base64.b64encode(r.randbytes(r.randint(30, 150))).decode(), ""),
        lambda: ("", f"{r.randint(1, 9)}.{r.randint(0, 99)}.{r.randint(0, 99)}-{word()}.{r.randint(2000, 2030)}{r.randint(10, 12)}{r.randint(10, 28)}", ""),
        lambda: ("", f"{r.randint(2000, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}.{r.randint(10, 59)}.{r.randint(10, 59)}Z", ""),
        lambda: ("", draw("-=_*+.", 1) * r.randint(12, 60), ""),
    ]
    paths = ["src0", "src7", "app/settings.py", "deploy/config.yml", "README.md", "tests/test_auth.py", "src/main.js", "docs/guide.txt", ""]
    rows, y = [], []
    for k in range(n):
        truth = k % 2
        head, value, tail = r.choice(secret if truth else other)()
        before = " ".join(word() for _ in range(6)) + " " + head
        after = tail + " " + " ".join(word() for _ in range(6))
        rows.append(features(value.encode(), before.encode(), after.encode(), r.choice(paths)))
        y.append(truth)
    return rows, y


class Forest:
    """Random forest for two classes: bootstrap rows, random features at each cut, Gini gain."""

    def __init__(self, trees: int = 40, depth: int = 9, least: int = 4, seed: int = 5):
        self.n, self.depth, self.least, self.rng = trees, depth, least, np.random.default_rng(seed)
        self.trees: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        tries = max(1, round(math.sqrt(x.shape[1])))
        for _ in range(self.n):
            rows = self.rng.integers(0, len(x), len(x))
            nodes: list[list[float]] = []  # feature, cut, left, right, share
            self._grow(nodes, x[rows], y[rows], 0, tries)
            a = np.array(nodes)
            self.trees.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))
        return self

    def _grow(self, nodes, x, y, depth, tries) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, at, at, float(y.mean())])
        if depth == self.depth or len(y) < 2 * self.least or y.min() == y.max():
            return at
        best = (1e-9, -1, 0.0)
        for f in self.rng.choice(x.shape[1], tries, replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y) + 1)
            ok = np.flatnonzero((v[:-1] < v[1:]) & (n[:-1] >= self.least) & (len(y) - n[:-1] >= self.least))
            if len(ok):
                nl, ol = n[ok], ones[ok]
                nr, orr = len(y) - nl, ones[-1] - ol
                gini = (ol * (nl - ol) / nl + orr * (nr - orr) / nr) / len(y)
                gain = y.mean() * (1 - y.mean()) - gini
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), int(f), float((v[ok[k]] + v[ok[k] + 1]) / 2))
        if best[1] < 0:
            return at
        left = x[:, best[1]] <= best[2]
        nodes[at][0], nodes[at][1] = best[1], best[2]
        nodes[at][2] = self._grow(nodes, x[left], y[left], depth + 1, tries)
        nodes[at][3] = self._grow(nodes, x[~left], y[~left], depth + 1, tries)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets in the leaves that each row falls into."""
        total = np.zeros(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth + 1):
                f = feature[at]
                at = np.where(f < 0, at, np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at], left[at], right[at]))
            total += share[at]
        return total / max(len(self.trees), 1)


@functools.lru_cache(maxsize=2)
def default_forest(n: int = 6000, seed: int = 11) -> Forest:
    x, y = labelled_findings(n, seed)
    return Forest().fit(np.array(x), np.array(y, float))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", forest: Forest | None = None, threshold: float = 0.5) -> DataFrame:
    """Findings in every whole text: doc_id, n_candidates, n_secrets, max_score, spans, findings_sha256.

    Candidates are all long runs of key characters, and after assignments and secret words the whole
    values from six characters on, quoted or up to white space, and private keys as a whole; none is passed
    over by number. The forest
    (fixed size, broadcast) removes false positives by length, entropy, letter transitions, share of
    common word parts, path and neighbouring words. forest: one fitted on own labelled findings;
    default_forest() is fitted on labelled_findings(), whose number of rows bounds the sample.
    spans are [start, end) in UTF-8 bytes, of overlapping secrets one; findings_sha256 digests the secrets found, in order,
    joined by newlines. Null and empty texts have no candidates, a null path is empty, repeated rows
    come back each, an empty table gives no rows, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest or default_forest())

    def work(batch):
        rows = []
        for text, spans, scores in _judged(raw(batch.column(1)), batch.column(2).to_pylist(), shared):
            secret = merged([s for s, p in zip(spans, scores.tolist(), strict=True) if p >= threshold])
            rows.append((len(spans), len(secret), float(scores.max()) if len(scores) else 0.0, secret, hashlib.sha256(b"\n".join(text[s:e] for s, e in secret)).hexdigest()))
        types = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.list_(pa.int64())), pa.string()]
        columns = [batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_candidates", "n_secrets", "max_score", "spans", "findings_sha256"])

    path = F.col(path_col).cast("string") if path_col in docs.columns else F.lit("")
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, n_candidates bigint, n_secrets bigint, max_score double, spans array<array<bigint>>, findings_sha256 string"
    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), path.alias("path")), work, schema)


def _judged(texts: list[bytes], paths: list, shared):
    """Each text with its candidates and their scores; the forest sees candidates of a few texts at once."""
    at = 0
    while at < len(texts):
        found, x, end = [], [], at
        while end < len(texts) and (end == at or len(x) < 5000):
            spans = candidates(texts[end])
            found.append(spans)
            x += [features(texts[end][s:e], texts[end][max(0, s - WINDOW) : s], texts[end][e : e + WINDOW], paths[end] or "") for s, e in spans]
            end += 1
        scores, used = shared.value.predict(np.array(x, float)) if x else np.zeros(0), 0
        for text, spans in zip(texts[at:end], found, strict=True):
            yield text, spans, scores[used : used + len(spans)]
            used += len(spans)
        at = end


def mask_secrets(docs: DataFrame, mask: str = "[SECRET]", text_col: str = "text", path_col: str = "source", length_col: str = "n_chars", forest: Forest | None = None, threshold: float = 0.5) -> DataFrame:
    """docs with mask in place of each secret that scan_secrets() finds; a column of text lengths follows.

    All rows and columns stay; null texts stay null, empty ones empty; repeated rows are masked each; an empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest or default_forest())
    names, at = docs.columns, docs.columns.index(text_col)
    path = names.index(path_col) if path_col in names else None

    def work(batch):
        paths = [""] * batch.num_rows if path is None else [None if p is None else str(p) for p in batch.column(path).to_pylist()]
        out, changed = [], []
        for text, spans, scores in _judged(raw(batch.column(at)), paths, shared):
            parts, last = [], 0
            for s, e in merged([s for s, p in zip(spans, scores.tolist(), strict=True) if p >= threshold]):
                parts += [text[last:s], mask.encode()]
                last = e
            out.append(b"".join([*parts, text[last:]]).decode("utf-8", "replace"))
            changed.append(last > 0)
        there = batch.column(at).is_valid().to_pylist()
        columns = list(batch.columns)
        columns[at] = pa.array([t if ok else None for t, ok in zip(out, there, strict=True)], pa.string())
        if length_col in names:
            i = names.index(length_col)
            old = batch.column(i).to_pylist()
            columns[i] = pa.array([len(t) if c else o for t, c, o in zip(out, changed, old, strict=True)], batch.column(i).type)
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(docs, work, docs.schema)
