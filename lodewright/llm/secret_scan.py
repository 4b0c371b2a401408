"""Secret scan: patterns propose candidates, a random forest trained on labelled findings removes false ones."""

from __future__ import annotations

import math
import random
import re
import string
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._hashing import LOWER, utf8_at

_BREAK = r"(?:[\r\n]|\\[rn])"
_ENDS = r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
#: Patterns by kind, in order of precedence; group "s" is the candidate. A key reaches to its end line, whatever stands
#: between; without one, over header lines and base64, where a line break may be written as an escape.
RULES = {
    "private_key": rf"(?P<s>-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:(?:[^-]|-(?!----))*+{_ENDS}|(?:{_BREAK}+[ \t]*+[A-Za-z][A-Za-z0-9-]*+:[ \t](?:(?!\\[rn])[^\r\n])*+)*+(?:[A-Za-z0-9+/=\s]|\\[rnt])*+))",
    "cloud_key_id": r"(?<![A-Za-z0-9])(?P<s>(?:AKIA|ASIA)[0-9A-Z]{16})(?![A-Za-z0-9])",
    "forge_token": r"(?<![A-Za-z0-9])(?P<s>gh[pousr]_[A-Za-z0-9]{36,})",
    "chat_token": r"(?<![A-Za-z0-9])(?P<s>xox[abprs]-[A-Za-z0-9-]{10,})",
    "web_token": r"(?<![A-Za-z0-9])(?P<s>eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,})",
    "url_credential": r"://(?:[^\s/:@\"'<>]*+:)?(?P<s>[^\s/\"'<>]+)@",
    "bearer": r"(?:(?i:authorization)[\"']?[ \t]*[:=][ \t]*[\"']?(?i:basic|bearer|token)|(?<![A-Za-z])(?i:bearer))[ \t]+(?P<s>[A-Za-z0-9._~+/-]{8,}=*)",
    "assigned": r"(?:[Pp]ass(?:word|wd)?|PASS(?:WORD|WD)?|[Pp]wd|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY|[Aa]ccess[_-]?[Kk]ey)[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']?(?P<s>[^\s\"'<>]{8,})",
    "hex_string": r"(?<![A-Za-z0-9])(?P<s>[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])",
    "high_entropy": r"(?<![A-Za-z0-9+/_-])(?P<s>[A-Za-z0-9+/_-]{20,}+={0,2})",
}
#: Bits a character, from which a run without a format of its own is a candidate; random ones of 20 characters have about 4.
LEAST_BITS = 3.0
#: Bits from which a transition counts as rare.
RARE_BITS = 8.0
#: Words whose nearness speaks for or against a finding.
NEAR_WORDS = ["password", "passwd", "secret", "token", "key", "api", "auth", "login", "user", "private", "example", "sample", "dummy", "fake", "test", "placeholder", "your", "changeme", "todo", "commit", "sha", "md5", "checksum", "hash", "digest", "etag", "uuid", "id", "revision", "version"]
#: Common words for the dictionary's coverage of a candidate.
DICTIONARY = ["access", "account", "admin", "apple", "change", "changeme", "client", "config", "correct", "data", "default", "demo", "dragon", "dummy", "enter", "example", "fake", "field", "function", "guest", "hello", "here", "home", "horse", "insert", "key", "letmein", "local", "login", "master", "monkey", "name", "none", "null", "object", "page", "pass", "password", "path", "placeholder", "private", "public", "qwerty", "replace", "root", "sample", "secret", "server", "service", "staple", "string", "summer", "system", "temp", "test", "text", "this", "token", "true", "user", "value", "variable", "welcome", "winter", "with", "world", "your"]
TEST_PATH = re.compile(r"(^|[/_.-])(tests?|examples?|samples?|docs?|fixtures?|mocks?|spec|demo)([/_.-]|$)", re.I)
AROUND = 48
KINDS = list(RULES)
FEATURES = ["length", "entropy", "letters", "capitals", "digits", "other", "class_changes", "same_pairs", "runs", "transitions", "rare_transitions", "dictionary", "vowels", "test_path", "has_path", *(f"kind_{k}" for k in KINDS), *(f"near_{w}" for w in NEAR_WORDS)]

_COMPILED = [(k, re.compile(p)) for k, p in RULES.items()]
_WORDS = sorted(DICTIONARY, key=len, reverse=True)


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in order; where two overlap, the kind that comes first in RULES stays."""
    taken: list[tuple[int, int, str]] = []
    for kind, pattern in _COMPILED:
        for m in pattern.finditer(text):
            a, b = m.span("s")
            while b > a + 1 and kind in ("assigned", "bearer") and text[b - 1] in ".,;:)]}*#&%$!":
                b -= 1
            if kind == "high_entropy" and _bits(text[a:b]) < LEAST_BITS:
                continue
            at = bisect(taken, (a, b))
            if (b - a >= 8 or kind == "url_credential") and not (at and taken[at - 1][1] > a) and not (at < len(taken) and taken[at][0] < b):
                taken.insert(at, (a, b, kind))
    return [(k, a, b) for a, b, k in taken]


def _bits(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def _kind_of(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def transition_counts(texts: DataFrame) -> np.ndarray:
    """How often each byte follows each other one, A-Z in lower case, in all texts (column text): 256 x 256 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for _, _, data, offsets in utf8_at(batch.column(0)):
                low = LOWER[data].astype(np.int32)
                pair = (low[:-1] << 8) | low[1:]
                starts = offsets[1:-1]
                seen += np.bincount(pair, minlength=1 << 16)
                across = starts[(starts > 0) & (starts < len(data))]
                np.subtract.at(seen, pair[np.unique(across) - 1], 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["pair", "n"])

    found = texts.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # 65,536 rows at most
    out = np.zeros(1 << 16)
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(256, 256)


@lru_cache(1)
def _dictionary_pairs() -> np.ndarray:
    """The transitions of the dictionary's words, as often as in a text of 20,000 letters: a few texts alone say little."""
    counts = np.zeros((256, 256))
    for w in [*DICTIONARY, *NEAR_WORDS]:
        x = np.frombuffer(w.encode(), np.uint8)
        np.add.at(counts, (x[:-1], x[1:]), 1)
    return counts * (20_000 / counts.sum())


def transition_bits(counts: np.ndarray | float = 0.0) -> np.ndarray:
    """Bits that each transition says, the less usual the more: a bigram model, with ten counts more for every pair."""
    counts = counts + _dictionary_pairs() + 10.0
    return -np.log2(counts / counts.sum(1, keepdims=True))


def features(secret: str, kind: str, before: str, after: str, path: str | None, bits: np.ndarray | None = None) -> list[float]:
    """FEATURES of a candidate; ``bits``: what each transition says, by default of the dictionary's words."""
    s = secret
    raw = LOWER[np.frombuffer(s.encode("utf-8", "surrogatepass"), np.uint8)]
    says = (transition_bits() if bits is None else bits)[raw[:-1], raw[1:]] if len(raw) > 1 else np.zeros(1)
    n = max(1, len(s))
    kinds = [_kind_of(c) for c in s]
    counts = [s.count(c) for c in set(s)]
    low = s.lower()
    covered, rest = 0, low
    for w in _WORDS:
        covered += len(w) * rest.count(w)
        rest = rest.replace(w, "\0")
    pairs = max(1, n - 1)
    words = set(re.findall(r"[a-z0-9]+", f"{before} {after}".lower()))
    values = [
        math.log1p(len(secret)),
        -sum(c / n * math.log2(c / n) for c in counts),
        kinds.count(0) / n,
        kinds.count(1) / n,
        kinds.count(2) / n,
        kinds.count(3) / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / pairs,
        sum(a == b for a, b in zip(s, s[1:])) / pairs,
        sum(ord(b) - ord(a) == 1 for a, b in zip(s, s[1:])) / pairs,
        float(says.mean()),
        float((says >= RARE_BITS).mean()),
        covered / n,
        sum(c in "aeiou" for c in low) / n,
        float(bool(path and TEST_PATH.search(path))),
        float(bool(path)),
    ]
    return values + [float(kind == k) for k in KINDS] + [float(w in words) for w in NEAR_WORDS]


def labelled_findings(n: int = 6000, seed: int = 7) -> list[tuple[str, str, str, str, str | None, int]]:
    """Findings with labels (secret, kind, before, after, path, label), made up from the formats themselves.

    Real ones: random strings of each format, assigned or standing in prose. False ones: placeholders, words,
    sequences and repeats in the same formats, and digests, revisions and identifiers that aren't secret.
    """
    r = random.Random(seed)
    upper, alnum, hexed = string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, "0123456789abcdef"
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    few = lambda chars: "".join(r.sample(chars, max(6, len(chars) // 3))) if r.random() < 0.3 else chars  # noqa: E731 - some keys repeat letters
    prose = lambda: " ".join(pick(string.ascii_lowercase, r.randint(2, 8)) for _ in range(r.randint(2, 5)))
    path = lambda test: r.choice([None, None, *(["tests/fixtures/a.py", "docs/example.md"] if test else ["src/settings.py", "deploy/prod.env", "app/config.yml"])])
    name = lambda: r.choice(["password", "passwd", "secret", "token", "api_key", "access_key"])
    out = []
    for i in range(n):
        real, kind = i % 2 == 0, r.choice(KINDS)
        before, after = prose() + " ", " " + prose()
        if kind == "cloud_key_id":
            s = "AKIA" + (pick(few(upper), 16) if real else r.choice(["IOSFODNN7EXAMPLE", "X" * 16, "0123456789ABCDEF", pick(upper, 9) + "EXAMPLE"]))
        elif kind == "forge_token":
            s = "ghp_" + (pick(few(alnum), r.choice([36, 36, 300])) if real else r.choice(["x" * 36, "your_token_here".ljust(36, "0").replace("_", ""), (string.digits * 4)[:36]]))
        elif kind == "chat_token":
            s = "xoxb-" + (f"{pick(string.digits, 12)}-{pick(alnum, 24)}" if real else r.choice(["your-token-goes-here", "0000000000-example", "xxxxxxxxxxxx"]))
        elif kind == "web_token":
            s = f"eyJ{pick(alnum, 30)}.eyJ{pick(alnum, r.choice([60, 60, 3000]))}.{pick(alnum + '-_', r.choice([43, 43, 700]))}" if real else f"eyJ{'header' * 3}.eyJ{'payload' * 3}.{'signature' * 2}"
        elif kind == "private_key":
            of, head = r.choice([("PRIVATE KEY", ""), ("RSA PRIVATE KEY", ""), ("RSA PRIVATE KEY", f"Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{pick('0123456789ABCDEF', 32)}\n\n"), ("PGP PRIVATE KEY BLOCK", "Version: GnuPG v2\n\n")])
            body = "\n".join(pick(alnum + "+/", 64) for _ in range(r.choice([2, 6, 25, 50, 250]))) if real else r.choice(["example", "...", "your key here", "x" * 64])
            s = f"-----BEGIN {of}-----\n{head}{body}" + r.choice([f"\n-----END {of}-----", f"\n-----END {of}-----", ""]) if real or r.random() < 0.5 else f"-----BEGIN {of}-----"
        elif kind == "assigned":
            before += f"{name()} {r.choice(['=', ':'])} "
            words = "".join(r.choice(DICTIONARY) for _ in range(r.randint(1, 3))).ljust(8, "0")
            s = r.choice([pick(few(alnum), r.randint(10, 40)), pick(alnum, r.randint(200, 600)), pick(few(hexed), r.choice([16, 18, 20, 32, 40])), pick(hexed.upper() if r.random() < 0.3 else hexed, r.choice([32, 40, 64])), pick(alnum + "!#%&*+-_", r.randint(10, 24))]) if real else r.choice([words, "x" * r.randint(8, 20), "your_password_here", "<placeholder>", "${PASSWORD}", "os.environ[0]", "get_secret()", "********", "12345678", "abcdefgh"])
        elif kind == "url_credential":
            before += f"{r.choice(['https', 'postgres', 'mysql', 'redis', 'ftp'])}://{r.choice(['', pick(string.ascii_lowercase, r.randint(3, 8)) + ':'])}"
            s = r.choice([pick(alnum, r.randint(6, 40)), pick(alnum + "!#%&*+-_", r.randint(8, 24))]) if real else r.choice(["git", "user", "pass", "password", "secret", "xxxx", "****", "${PASSWORD}", "{password}", "changeme", "root"])
            after = f"@{pick(string.ascii_lowercase, r.randint(3, 8))}.{r.choice(['com', 'net', 'internal'])}" + after
        elif kind == "bearer":
            before += r.choice(["Authorization: Bearer ", "authorization: Basic ", "bearer "])
            s = pick(alnum + r.choice(["", "-_", "+/", "._~"]), r.randint(16, 80)) if real else r.choice(["".join(r.choice(DICTIONARY) for _ in range(2)).ljust(8, "0"), "x" * r.randint(8, 24), "YOUR_TOKEN", "certificates", "instrument", "authentication", pick(string.ascii_lowercase, r.randint(8, 14))])
        elif kind == "high_entropy":
            some = lambda k: [r.choice(DICTIONARY) for _ in range(k)]
            before += f"{r.choice(['key', 'auth', 'login', 'private', 'api', 'use', 'is', 'value'])} " if real else r.choice(["", "file ", "id ", "uuid ", "digest ", "checksum ", "see "])
            s = pick(alnum + r.choice(["", "+/", "-_"]), r.randint(20, 80)) if real else r.choice(["/".join(some(r.randint(4, 7))), "_".join(some(r.randint(4, 7))), "-".join(some(r.randint(4, 7))), "".join(w.capitalize() for w in some(r.randint(4, 7))), "-".join(pick(hexed, k) for k in (8, 4, 4, 4, 12)), "-".join(pick(string.ascii_lowercase, r.randint(3, 8)) for _ in range(5)), "-" * 12 + "".join(some(3))])
        else:
            s = pick(hexed, r.choice([32, 40, 64, 256]))
            s = s.upper() if r.random() < 0.3 else s
            before += (f"{name()} " if real else r.choice(["commit ", "sha ", "md5 ", "checksum ", "etag ", "revision ", "hash ", "digest ", "id "]))
            if not real and r.random() < 0.3:
                s = r.choice(["0" * 40, "deadbeef" * 5, (hexed * 3)[:40]])
        if not real and r.random() < 0.4:
            before = f"{r.choice(['example', 'sample', 'dummy', 'test', 'placeholder'])} " + before
        out.append((s, kind, before[-AROUND:], after[:AROUND], path(not real and r.random() < 0.5), int(real)))
    return out


def train_forest(spark: SparkSession, findings: list[tuple[str, str, str, str, str | None, int]] | None = None, bits: np.ndarray | None = None, trees: int = 100, depth: int = 8, seed: int = 3):
    """A forest over FEATURES from labelled findings (at most a few thousand, held by the driver)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = [(features(*x[:5], bits), float(x[5])) for x in (findings or labelled_findings())]
    data = spark.createDataFrame(rows, "x array<double>, label double").coalesce(1).select(array_to_vector("x").alias("features"), "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=2, featureSubsetStrategy="onethird").fit(data)


def scan(docs: DataFrame, findings: list | None = None, threshold: float = 0.5, id_column: str = "doc_id", text_column: str = "text", path_column: str | None = None) -> DataFrame:
    """One row per candidate: doc_id, kind, start, length (in characters), secret, score, is_secret.

    Whole texts are read, twice: how usual a candidate's character transitions are is told by a bigram model of all texts. Null and empty texts, and texts without candidates, have no rows; rows with null or
    repeated ids have rows each. Only the named columns are read; an empty table gives an empty table.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array

    bits = transition_bits(transition_counts(docs.select(F.col(text_column).cast("string").alias("text"))))
    model = train_forest(docs.sparkSession, findings, bits)
    path = F.col(path_column).cast("string") if path_column else F.lit(None).cast("string")
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                at, kinds, starts, sizes, secrets, x = [], [], [], [], [], []
                for i, (text, where) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    for k, a, b in candidates(text or ""):
                        at.append(i), kinds.append(k), starts.append(a), sizes.append(b - a), secrets.append(text[a:b])
                        x.append(features(text[a:b], k, text[max(0, a - AROUND) : a], text[b : b + AROUND], where, bits))
                if at:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(kinds), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(secrets), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "kind", "start", "length", "secret", "x"])

    found = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"), path.alias("path")).mapInArrow(run, f"doc_id {kind}, kind string, start int, length int, secret string, x array<double>")
    scored = model.transform(found.withColumn("features", array_to_vector("x")))
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", "kind", "start", "length", "secret", score.alias("score"), (score >= threshold).alias("is_secret"))


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    """A document's source stands for its path."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), path_column="source")
    return found.select("doc_id", "kind", "start", "length", F.sha2("secret", 256).alias("secret_sha256"), "score", "is_secret")
