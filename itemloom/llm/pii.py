"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, schemes, dial signs and identifier cues in one pass over a text; local parsers
expand each anchor to the left and right and validate what they find. Digit groups (IP addresses, card numbers) have
no fixed anchor string; runs of digits are theirs, and two capitals with two digits that of an IBAN. A cue is a whole word.
All parsers are linear in the text, however long it is, and none has a bound on what it finds.

Kinds, in the order in which ties are listed: email, ip, card, phone (the base kinds), then url_user (name and password
in a URL), account (a number behind a cue such as "account no."), iban (valid by its check digits), secret (a value that a cue
such as "token" or "password" is given by a sign of assignment or in quotes, or that follows "bearer"), key (a key of a service
by its own prefix and length).

Defined results: a null text counts as empty; spans are in code points, ends exclusive; spans of different kinds may
overlap and are all reported, those of one start and kind by their ends; texts of any length are read whole; repeated rows
give equal rows; an empty table gives no rows; further columns are ignored.
Masking merges overlapping spans and names the first one's kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

# The kinds in their order, and the cues that stand before an identifier.
KINDS = ("email", "ip", "card", "phone", "url_user", "account", "iban", "secret", "key")
BASE = KINDS[:4]
CUES = ("account number", "account no", "account", "acct no", "acct", "a/c no", "konto", "kontonummer", "compte", "cuenta", "iban", "passport no", "passport", "ssn", "tax id", "user id", "customer id")

SECRET_CUES = ("token", "secret", "password", "passwd", "passphrase", "pwd", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "secret key", "secret_key", "private key", "private_key", "bearer")
KEY_HEADS = ("aiza", "sk-", "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "github_pat_", "akia", "asia", "xoxb-", "xoxp-", "xoxa-", "glpat-")
KEY_SHAPES = (r"AIza[A-Za-z0-9_-]{30,}", r"sk-(?:proj-|ant-)?[A-Za-z0-9_-]{20,}", r"gh[pousr]_[A-Za-z0-9]{20,}", r"github_pat_[A-Za-z0-9_]{20,}", r"A[KS]IA[A-Z0-9]{16}", r"xox[abp]-[A-Za-z0-9-]{10,}", r"glpat-[A-Za-z0-9_-]{20,}")

CUE_WORDS, SECRET_WORDS, KEY_WORDS = frozenset(CUES), frozenset(SECRET_CUES), frozenset(KEY_HEADS)
#: What stands between a cue and its secret: perhaps a quote that closes the name, then a sign and perhaps a quote.
_GIVEN = re.compile(r"""["']?[ \t]*(?::=|=>|[:=])[ \t]*["']?|[ \t]+(?:is[ \t]+)?["']|(?<=[Rr])[ \t]+""")
_QUOTED = re.compile(r"""[^"'\s]{6,}(?=["'])""")
_VALUE = re.compile(r"[A-Za-z0-9+/=_.~$!#%^&*-]+")
_KEY = re.compile("(?:" + "|".join(KEY_SHAPES) + ")")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run that fails from its start fails from each later digit too, so only starts of runs are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=:-]++@")
_SEPARATOR = re.compile(r"[ \t]*(?:number|no\.?|nr\.?|id)?[ \t]*[:#=]?[ \t]*", re.I)
_ACCOUNT = re.compile(r"[A-Za-z0-9][A-Za-z0-9-]{4,33}(?![A-Za-z0-9-])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: Two capitals and two digits at the start of a word anchor an IBAN that no cue announces.
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9]{4})")
_DIGIT = re.compile("[0-9]")


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in ("@", "://", "+", *CUES, *SECRET_CUES, *KEY_HEADS):
        a.add_word(w, (len(w), w))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def iban_valid(s: str) -> bool:
    plain = s.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _emails(text: str, ats: list[int]) -> Iterator[tuple[int, int]]:
    end = 0
    for at in ats:
        left = at
        while left > end and text[left - 1] in _LOCAL:
            left -= 1
        if left < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield left, end


def _phones(text: str, pluses: list[int]) -> Iterator[tuple[int, int]]:
    end = 0
    for at in pluses:
        if at >= end and (m := _PHONE.match(text, at)):
            end = m.end()
            if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                yield at, end


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Valid IBANs. Of a run of groups, the longest start whose check digits hold; what follows may be a word in capitals."""
    end = 0
    for m in _IBAN_HEAD.finditer(text):
        if m.start() < end or not (full := _IBAN.match(text, m.start())):
            continue
        stops = [full.end(), *(k for k in range(full.end() - 1, m.start() + 14, -1) if text[k] == " ")]
        for stop in stops:
            if iban_valid(text[m.start() : stop]):
                end = stop
                yield m.start(), stop
                break


def _secrets(text: str, folded: str, cues: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Values behind cues: in quotes 6 characters or more, else 8 or more with a digit, and 16 or more behind "bearer"."""
    done = 0
    for at, n in cues:
        if at < done or at > n and text[at - n - 1].isalnum() or at < len(text) and text[at].isalnum():
            continue  # in a value, or the cue is a part of a longer word
        given = _GIVEN.match(text, at)
        bearer = folded.startswith("bearer", at - n)
        if not given or given.end() < done or given[0].isspace() and not bearer:
            continue
        s = given.end()
        if given[0][-1] in "\"'" and (m := _QUOTED.match(text, s)):
            done = m.end()
            yield s, done
        elif m := _VALUE.match(text, s):
            done, value = m.end(), m[0].rstrip(".!")
            if len(value) >= (16 if bearer else 8) and _DIGIT.search(value):
                yield s, s + len(value)


def _keys(text: str, heads: list[int]) -> Iterator[tuple[int, int]]:
    end = 0
    for at in heads:
        if at >= end and not (at and (text[at - 1].isalnum() or text[at - 1] == "_")) and (m := _KEY.match(text, at)):
            end = m.end()
            yield at, end


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """All spans as (start, end, kind), by start, then by kind."""
    if not text:
        return []
    ats, pluses, schemes, cues, secrets, keys = [], [], [], [], [], []
    folded = text.lower()
    if len(folded) != len(text):  # some characters change length; A-Z suffice for the cues
        folded = "".join(c.lower() if c < "\x80" else c for c in text)
    for last, (n, w) in automaton().iter(folded):
        if w in CUE_WORDS:
            cues.append((last + 1, n))
        elif w in SECRET_WORDS:
            secrets.append((last + 1, n))
        elif w in KEY_WORDS:
            keys.append(last + 1 - n)
        else:
            (ats if w == "@" else pluses if w == "+" else schemes).append(last + 1 if n > 1 else last)
    found = [(s, e, "email") for s, e in _emails(text, ats)]
    found += [(s, e, "phone") for s, e in _phones(text, pluses)]
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(n := x.lstrip("0")) <= 3 and int(n or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        ibans = list(_ibans(text))
        found += [(s, e, "iban") for s, e in ibans]
        taken, done = {s: e for s, e in ibans}, 0
        for at, n in sorted(cues):
            if at < done or at < len(text) and text[at - 1].isalnum() and text[at].isalpha() or at > n and text[at - n - 1].isalnum():
                continue  # inside a found one, or the cue is the head or the tail of a longer word
            s = _SEPARATOR.match(text, at).end()
            if s in taken:
                done = taken[s]
                continue
            if s > at and (m := _ACCOUNT.match(text, s)) and len(_DIGIT.findall(m[0])) >= 5:
                found.append((m.start(), m.end(), "account"))
                done = m.end()
    found += [(s, e, "secret") for s, e in _secrets(text, folded, sorted(secrets))]
    found += [(s, e, "key") for s, e in _keys(text, sorted(keys))]
    for at in schemes:
        if m := _USERINFO.match(text, at):
            found.append((at, m.end() - 1, "url_user"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def spell(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        spans = [find_spans(x) for x in batch.column("text").to_pylist()]
        yield {
            "doc_id": batch.column("doc_id"),
            **{f"n_{k}": [sum(x[2] == k for x in row) for row in spans] for k in BASE},
            "base_sha256": [hashlib.sha256(spell([x for x in row if x[2] in BASE]).encode()).hexdigest() for row in spans],
            "spans": [spell(row) for row in spans],
        }


def personal_data(documents: DataFrame) -> DataFrame:
    """A row for each document: counts of the base kinds, a digest of their spans, and all spans."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(docs, _rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


op5 = personal_data


def mask(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    if not text:
        return text
    out, at = [], 0
    merged: list[list] = []
    for s, e, k in find_spans(text):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, k])
    for s, e, k in merged:
        out += [text[at:s], f"[{k}]"]
        at = e
    return "".join([*out, text[at:]])


def mask_documents(documents: DataFrame) -> DataFrame:
    """The documents with personal data masked; n_chars follows the text.

    Null and empty texts stay as they are, as do rows with null ids, repeated rows and further columns; an empty table stays empty.
    """
    schema = documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [mask(x) for x in batch.column("text").to_pylist()]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"text": pa.array(texts, batch.schema.field("text").type)}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    return documents.mapInArrow(run, schema)
