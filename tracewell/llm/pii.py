"""Personal data by anchor expansion.

An Aho-Corasick automaton finds, in one pass over a text, the anchors: at-signs,
digits, a plus before a digit, schemes with a host, and the cues of accounts and
secrets.  A small parser for each kind then works outwards from the anchor and
validates what it has found; text without anchors costs only the scan.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewell.llm.common import slices, text_of

BASE = ("email", "ip", "card", "phone")
# fixed values of the base kinds
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
RUN = re.compile(r"[0-9]+")
# what the added kinds look like behind their cue
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
USER_AT_HOST = re.compile(r"[^\s/@:\"'<>]+(:[^\s/@\"'<>]*)?@[A-Za-z0-9.-]+")
ACCOUNT_CUES = ("iban", "account", "konto", "compte", "cuenta")
ACCOUNT = re.compile(r"[\s:#=.-]{0,6}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey")
SECRET = re.compile(r"\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_=-]{16,})")


@cache
def automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for digit in "0123456789":
        auto.add_word(digit, ("digit", 1))
        auto.add_word("+" + digit, ("phone", 2))
    auto.add_word("@", ("email", 1))
    for kind, cues in (("url", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                auto.add_word(form, (kind, len(cue)))
    auto.make_automaton()
    return auto


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    flat = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def _octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """(start, end) in code points by kind, leftmost and without overlap inside a kind."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE, "account", "secret", "url")}
    after = dict.fromkeys([*found, "run"], 0)

    def add(kind: str, start: int, end: int) -> None:
        found[kind].append((start, end))
        after[kind] = max(after[kind], end)

    for last, (kind, size) in automaton().iter(text):
        at, end = last - size + 1, last + 1
        if kind == "digit":
            if at >= after["card"] and (m := CARD.match(text, at)):
                after["card"] = m.end()
                digits = "".join(RUN.findall(m[0]))
                if 16 <= len(digits) <= 19 and luhn(digits):
                    add("card", at, m.end())
            if at >= after["ip"] and at >= after["run"]:
                if m := IP.match(text, at):
                    after["ip"] = m.end()
                    if all(map(_octet, m[0].split("."))):
                        add("ip", at, m.end())
                else:  # no later digit of this run can begin one
                    after["run"] = RUN.match(text, at).end()
        elif kind == "email":
            start = at
            while start > after["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, end)):
                add("email", start, m.end())
        elif kind == "phone":
            if at >= after["phone"] and (m := PHONE.match(text, at)):
                after["phone"] = m.end()
                if 8 <= sum(len(x) for x in RUN.findall(m[0])) <= 15:
                    add("phone", at, m.end())
        elif kind == "url":
            if at >= after["url"] and (m := USER_AT_HOST.match(text, end)):
                add("url", at, m.end())
        elif kind == "account":
            if (m := ACCOUNT.match(text, end)) and m.start(1) >= after["account"] and iban(m[1]):
                add("account", m.start(1), m.end(1))
        elif (m := SECRET.match(text, end)) and m.start(1) >= after["secret"]:
            add("secret", m.start(1), m.end(1))
    return found


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): one row for every row of ``docs``.

    spans lists kind:start:end of all kinds: the four base kinds in that order,
    then accounts, secrets and URLs with a user; base_sha256 is the hash of the
    part with the base kinds.  A null or empty text has no spans.
    """
    source = text_of(docs, doc_id, text)
    counts = [f"n_{k}" for k in BASE]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in range(6)]
            for text in batch.column("text").to_pylist():
                found = spans(text or "")
                listed = {k: [f"{k}:{a}:{b}" for a, b in v] for k, v in found.items()}
                for i, k in enumerate(BASE):
                    out[i].append(len(found[k]))
                out[4].append(hashlib.sha256(",".join(x for k in BASE for x in listed[k]).encode()).hexdigest())
                out[5].append(",".join(x for v in listed.values() for x in v))
            arrays = [pa.array(x, pa.int64()) for x in out[:4]] + [pa.array(x, pa.string()) for x in out[4:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *counts, "base_sha256", "spans"])

    kind = dict(source.dtypes)["doc_id"]
    return source.mapInArrow(kernel, f"doc_id {kind}, {', '.join(f'{c} long' for c in counts)}, base_sha256 string, spans string")
