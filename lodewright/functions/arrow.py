"""Functions that need Python, batch-wise: dates, sequence similarity, stems, HTML."""

from __future__ import annotations

import datetime
import re
import string
from collections.abc import Callable, Iterable
from difflib import SequenceMatcher
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NO_PUNCTUATION = str.maketrans("", "", string.punctuation)


@lru_cache(4096)
def normalize_string(text: str, today: str = "2000-01-01") -> str:
    """Dates as a year or a day, other text in lower case without punctuation; missing date parts come from ``today``."""
    from dateutil import parser

    text = text.lower().strip()
    if any(c.isdigit() for c in text):
        try:
            found = parser.parse(text, default=datetime.datetime.fromisoformat(today))
            return str(found.year) if text == str(found.year) else found.strftime("%Y-%m-%d")
        except (ValueError, OverflowError, TypeError):
            pass
    return " ".join(text.translate(_NO_PUNCTUATION).split())


def normalize_dates(today: str = "2000-01-01") -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else normalize_string(x, today))

    return run


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def sequence_ratio(a: Column | str, b: Column | str) -> Column:
    """Ratcliff and Obershelp's 2M/T; the order of the arguments matters."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run(a, b)


def native_similarity(a: str, b: str) -> bool:
    """The tiers without the ratio: equal, inside, words overlapping by over 0.66."""
    if a == b or a in b or b in a:
        return True
    x, y = set(a.split()), set(b.split())
    return bool(x and y) and len(x & y) / min(len(x), len(y)) > 0.66


@lru_cache(1 << 16)
def smart_similarity(a: str, b: str) -> bool:
    """All tiers: those of ``native_similarity``, then a sequence ratio over 0.85."""
    if native_similarity(a, b):
        return True
    return bool(a and b) and 2 * min(len(a), len(b)) > 0.85 * (len(a) + len(b)) and ratio(a, b) > 0.85


_SPACES = re.compile(r"[ \t\n\x0b\f\r]+")  # white space to Spark's split


def first_like(golds: Iterable[str | None], preds: Iterable[str | None]) -> list[int]:
    """For each of ``golds`` the place of the first of ``preds`` that ``matching.similar`` holds for; -1 if there is none.

    The native tiers go first; the ratio is asked only for what comes before their first hit, up to its own first. Its
    upper bound by letters alone rules most pairs out, and so does length where all letters would have to be equal.
    """
    preds = list(preds)
    words = [set(_SPACES.split(p)) - {""} if p is not None else set() for p in preds]
    places: dict[str, list[int]] = {}
    for i, own in enumerate(words):
        for w in own:
            places.setdefault(w, []).append(i)
    text = [(i, p) for i, p in enumerate(preds) if p is not None]
    sized = [(i, len(p)) for i, p in text if p]
    matchers: dict[int, SequenceMatcher] = {}
    out = []
    for g in golds:
        if g is None:
            out.append(-1)
            continue
        best = next((i for i, p in text if g in p or p in g), len(preds))
        own, shared = set(_SPACES.split(g)) - {""}, {}
        for w in own:
            for i in places.get(w, ()):
                shared[i] = shared.get(i, 0) + 1
        best = min((i for i, n in shared.items() if i < best and n / min(len(own), len(words[i])) > 0.66), default=best)
        la = len(g)
        strict = la > 0 and not (la - 1) / la > 0.85  # of two texts as short as this only equal ones have the ratio
        for i, lb in sized:
            if i >= best:
                break
            if 2 * min(la, lb) > 0.85 * (la + lb) and not (strict and la == lb):
                if i not in matchers:
                    matchers[i] = SequenceMatcher(None, "", preds[i])
                matchers[i].set_seq1(g)
                if matchers[i].quick_ratio() > 0.85 and matchers[i].ratio() > 0.85:
                    best = i
        out.append(best if best < len(preds) else -1)
    return out


def first_like_of(golds: Column, preds: Column) -> Column:
    """``first_like`` over two columns of arrays: an array of places, from 0."""

    @F.pandas_udf("array<int>")
    def run(golds: pd.Series, preds: pd.Series) -> pd.Series:
        return pd.Series([first_like(g, p) for g, p in zip(golds, preds, strict=True)], dtype="object")

    return run(golds, preds)


# -- Snowball English ("Porter2"), after its published description ------------------------------------------------

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Fixed values of the published algorithm.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_UNCHANGED_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("entli", "ent"), ("izer", "ize"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("aliti", "al"), ("alli", "al"), ("fulness", "ful"), ("ousli", "ous"), ("ousness", "ous"), ("iveness", "ive"), ("iviti", "ive"), ("biliti", "ble"), ("bli", "ble"), ("fulli", "ful"), ("lessli", "less")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize"]


def _regions(word: str) -> tuple[int, int]:
    def after(start: int) -> int:
        for i in range(start + 1, len(word)):
            if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
                return i + 1
        return len(word)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-1] not in _VOWELS + "wxY" and word[-2] in _VOWELS and word[-3] not in _VOWELS


@lru_cache(65536)
def stem(word: str) -> str:
    word = word.lower()
    if len(word) <= 2:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    word = word.lstrip("'")
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    r1, r2 = _regions(word)
    for end in ("'s'", "'s", "'"):
        if word.endswith(end):
            word = word[: -len(end)]
            break
    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(c in _VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in _UNCHANGED_AFTER_1A:
        return word
    # 1b
    for end in ("eedly", "eed", "ingly", "edly", "ing", "ed"):
        if not word.endswith(end):
            continue
        if end.startswith("eed"):
            if len(word) - len(end) >= r1:
                word = word[: -len(end)] + "ee"
        elif any(c in _VOWELS for c in word[: -len(end)]):
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(_DOUBLES):
                word = word[:-1]
            elif len(word) <= r1 and _short_end(word):
                word += "e"
        break
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    # 2
    best = max((x for x in [*_STEP2, ("ogi", "og"), ("li", "")] if word.endswith(x[0])), key=lambda x: len(x[0]), default=None)
    if best and len(word) - len(best[0]) >= r1:
        base = word[: -len(best[0])]
        if best[0] == "ogi":
            word = base + "og" if base.endswith("l") else word
        elif best[0] == "li":
            word = base if base and base[-1] in "cdeghkmnrt" else word
        else:
            word = base + best[1]
    # 3
    best = max((x for x in [*_STEP3, ("ative", "")] if word.endswith(x[0])), key=lambda x: len(x[0]), default=None)
    if best and len(word) - len(best[0]) >= r1:
        if best[0] != "ative":
            word = word[: -len(best[0])] + best[1]
        elif len(word) - 5 >= r2:
            word = word[:-5]
    # 4
    best = max((x for x in [*_STEP4, "ion"] if word.endswith(x)), key=len, default=None)
    if best and len(word) - len(best) >= r2 and (best != "ion" or word[: -len(best)].endswith(("s", "t"))):
        word = word[: -len(best)]
    # 5
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


_TOKEN = re.compile(r"[^\W_]+(?:[.,'’-][^\W_]+)*|\S")


def stem_text(text: str) -> str:
    """Stems of the words that are letters and digits alone, with single spaces."""
    return " ".join(stem(w) for w in _TOKEN.findall(text.lower()) if w.isalnum())


def stemmed(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else stem_text(x))

    return run(text)


# -- HTML ----------------------------------------------------------------------------------------------------------


class _Links(HTMLParser):
    """Links and the text of the list items inside a container of a given class; all links if there is none."""

    def __init__(self, container: str | None):
        super().__init__()
        self.container, self.depth, self.found, self.item, self.link = container, 0 if container else 1, [], None, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = dict(attrs)
        if self.container and tag == "div":
            if self.depth or self.container in (named.get("class") or "").split():
                self.depth += 1
        if self.depth and tag == "li":
            self.item = {"title": "", "link": None, "description": ""}
        if self.depth and tag == "a" and self.item is not None and self.item["link"] is None:
            self.item["link"], self.link = named.get("href"), True

    def handle_data(self, data: str) -> None:
        if self.item is not None:
            self.item["title" if self.link else "description"] += data

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.link = None
        if tag == "li" and self.item is not None:
            if self.item["link"]:
                self.found.append({k: v.strip() if v else v for k, v in self.item.items()})
            self.item = None
        if self.container and tag == "div" and self.depth:
            self.depth -= 1


def list_links(html: str | None, container: str | None = None) -> list[dict]:
    reader = _Links(container)
    reader.feed(html or "")
    return reader.found


def html_links(container: str | None = None) -> Callable[[Column], Column]:
    @F.pandas_udf("array<struct<title:string,link:string,description:string>>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda x: list_links(x, container))

    return run


class _Table(HTMLParser):
    """The rows of the first table with a given class (any if None), as cells of text."""

    def __init__(self, name: str | None):
        super().__init__()
        self.name, self.state, self.rows, self.cell = name, 0, [], None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table" and not self.state and (self.name is None or self.name in (dict(attrs).get("class") or "").split()):
            self.state = 1
        elif self.state == 1 and tag == "tr":
            self.rows.append([])
        elif self.state == 1 and tag in ("td", "th") and self.rows:
            self.cell = ""

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell += data

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append(self.cell.strip())
            self.cell = None
        elif tag == "table" and self.state == 1:
            self.state = 2


def table_records(html: str | None, name: str | None = "table-striped") -> list[dict[str, str]]:
    reader = _Table(name)
    reader.feed(html or "")
    head, *rows = reader.rows or [[]]
    return [dict(zip(head, r, strict=False)) for r in rows]


def html_table(name: str | None = "table-striped") -> Callable[[Column], Column]:
    @F.pandas_udf("array<map<string,string>>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda x: table_records(x, name))

    return run
