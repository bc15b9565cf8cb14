"""Quality rules by tokeniser fertility.

Two public vocabularies measure each text: a byte-level BPE gives characters per token and the entropy of the tokens, a
piece model with byte fallback gives the share of tokens that are single bytes. A text is rejected when a measure lies
outside the band of its language, or of its script where the language is none of those with a band of their own. The base
counts (words, symbols, repeated lines, repeated five-word windows) come with them; a text that fails the base rules is
not kept. One narrow pass over whole texts, no shuffle.

The entropy of n tokens is log2(n) at most, so the least entropy of a band is scaled by log2(n) / log2(64) where a text
has fewer than 64 tokens: short texts are judged by the same law.

Defined results: a null text counts as empty: no words, so base_failed; texts of any length are read whole; a text without
letters has the script 'other'; a language counts only where the text is in its script, a null or unknown one not at all;
a table without a column lang is judged by scripts; measures that equal a bound are inside; repeated rows are judged
alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, map_arrow, rank_encoder, tokenizer_path, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Bits of entropy that a text needs for a band's least to apply unscaled: log2 of 64 tokens.
FULL_BITS = 6

# For each script or language the least and the largest characters per token, the largest share of byte tokens
# and the least entropy in bits. Grounds, measured with the two vocabularies (characters per token; byte share; entropy):
#   random data: base64 1.31, base85 1.19, hex 1.66 to 1.71, UUIDs 1.50, random letters 1.76, letters and digits 1.44;
#   English licence texts 3.6 to 4.4; 0.08; 6.3 to 8.3 - program code 2.3 to 2.8; 0.10; 6.1 to 6.6;
#   invented prose of the test tables that passes the base rules, least to largest: en 2.17 to 3.18, de 1.84 to 2.81,
#   fr 1.91 to 2.65, es 1.82 to 2.48; up to 0.08; from 3.8;
#   declarations of human rights: Cyrillic 0.93, Greek 0.89, Arabic 0.97, Hebrew 0.82, Japanese 0.78, Korean 0.44;
#   up to 0.08; 4.3 to 5.9 - the same as mojibake 0.59 to 1.18; 0; 3.0 to 5.4.
# Languages of the first group have a floor between random data and prose. Other languages in plain Latin letters have
# about two characters a token or more; those whose letters carry stacked or rare marks have about one, as Vietnamese (1.08)
# and Yoruba (0.97): 'latin_marked'. Letters of further scripts may be unknown to the piece model, which then spells them
# all in bytes: 'other_letters' (Thai 0.54, Tamil 0.36, Amharic 0.41 with 0.82 bytes; entropy from 3.1).
BANDS = {
    "en": (1.78, 9.0, 0.20, 3.5),
    "de": (1.78, 9.0, 0.20, 3.5),
    "fr": (1.78, 9.0, 0.20, 3.5),
    "es": (1.78, 9.0, 0.20, 3.5),
    "latin": (1.5, 9.0, 0.25, 3.0),
    "latin_marked": (0.8, 9.0, 0.40, 3.0),
    "cyrillic": (0.5, 6.0, 0.25, 3.0),
    "greek": (0.4, 5.0, 0.30, 3.0),
    "arabic": (0.4, 5.0, 0.40, 3.0),
    "hebrew": (0.4, 5.0, 0.40, 3.0),
    "cjk": (0.25, 3.0, 0.70, 3.0),
    "other": (0.2, 9.0, 0.90, 2.0),
    "other_letters": (0.2, 9.0, 1.00, 2.0),
}
#: The script in which a language's own band applies.
LANGUAGES = {"en": "latin", "de": "latin", "fr": "latin", "es": "latin"}
_SCRIPTS = {
    "latin": re.compile("[A-Za-z\xc0-\u024f\u1e00-\u1eff]"),
    "cyrillic": re.compile("[\u0400-\u052f]"),
    "greek": re.compile("[\u0370-\u03ff\u1f00-\u1fff]"),
    "arabic": re.compile("[\u0600-\u06ff\u0750-\u077f]"),
    "hebrew": re.compile("[\u0590-\u05ff]"),
    "cjk": re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]"),
}
_NOT_LATIN = re.compile("[\u0370-\u1dff\u1f00-\u1fff\u2c00-\u2dff\u3040-\ud7ff\uf900-\U0010ffff]")
#: Latin letters beyond Latin-1, which UTF-8 that was read as Latin-1 doesn't hold, and combining marks.
_MARKED = re.compile("[\u0100-\u024f\u0300-\u036f\u1e00-\u1eff]")
MARKED_PERCENT = 5
LETTERS_PERCENT = 30


def script_of(text: str) -> str:
    """The script with the most letters; letters of any further script count as 'other'; ties go to the one listed first."""
    if not _NOT_LATIN.search(text):
        return "latin" if _SCRIPTS["latin"].search(text) else "other"
    counts = {k: sum(1 for _ in p.finditer(text)) for k, p in _SCRIPTS.items()}
    known = sum(sum(map(str.isalpha, p.findall(text))) for p in _SCRIPTS.values())
    counts["other"] = sum(map(str.isalpha, text)) - known
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


def band_of(text: str, script: str, lang: str | None = None) -> str:
    """The language's band in its own script, else the script's: latin_marked where MARKED_PERCENT of a Latin text's letters
    have rare marks, other_letters where LETTERS_PERCENT of another text are letters."""
    if LANGUAGES.get(lang) == script:
        return lang
    if script == "other" and text and 100 * sum(map(str.isalpha, text)) >= LETTERS_PERCENT * len(text):
        return "other_letters"
    if script == "latin" and (marked := sum(1 for _ in _MARKED.finditer(text))):
        if 100 * marked >= MARKED_PERCENT * sum(1 for _ in _SCRIPTS["latin"].finditer(text)):
            return "latin_marked"
    return script


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows that the text holds twice or more, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(grams)) == n:
        return 0
    counts = Counter(grams)
    marked = np.zeros(len(words) + 1, np.int64)
    at = np.array([i for i, g in enumerate(grams) if counts[g] > 1])
    marked[at] += 1
    np.subtract.at(marked, at + window, 1)
    return int((np.cumsum(marked) > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines that hold a word and equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


@lru_cache(maxsize=2)
def piece_model(path: str):
    """The piece model and, for each id, whether it is a single byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])


def entropy(ids: np.ndarray) -> float:
    if not len(ids):
        return 0.0
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    return float(-(p * np.log2(p)).sum()) + 0.0


def _measure(batches: Iterator[pa.RecordBatch], ranks_path: str, piece_path: str, bands: dict) -> Iterator[dict]:
    encoder, (pieces, is_byte) = rank_encoder(ranks_path), piece_model(piece_path)
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "script", "band", "n_tokens", "chars_per_token", "byte_share", "token_entropy", "reason")}
        langs = batch.column("lang").to_pylist() if "lang" in batch.schema.names else [None] * batch.num_rows
        for doc_id, text, lang in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), langs, strict=True):
            text = text or ""
            words = words_of(text)
            repeats = repeated_words(words)
            failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
            ids = encoder.encode_to_numpy(text, disallowed_special=())
            script = script_of(text)
            parts = np.array(pieces.encode(text), np.int64)
            per_token = len(text) / len(ids) if len(ids) else 0.0
            share = float(is_byte[parts].mean()) if len(parts) else 0.0
            bits = entropy(ids)
            band = band_of(text, script, lang)
            least, most, bytes_most, bits_least = bands[band]
            reason = None
            if failed:
                reason = "base"
            elif not least <= per_token <= most:
                reason = "chars_per_token"
            elif share > bytes_most:
                reason = "byte_share"
            elif bits < bits_least * min(1.0, np.log2(len(ids)) / FULL_BITS):
                reason = "token_entropy"
            row = (doc_id, len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), repeated_lines(text), repeats, failed, reason is None, script, band, len(ids), round(per_token, 6), round(share, 6), round(bits, 6), reason)
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        yield out


def fertility_rules(documents: DataFrame, ranks_path: str, piece_path: str, bands: dict | None = None) -> DataFrame:
    """A row for each document: the base counts, the measures, kept, and the first rule that rejects it (null: none)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(["lang"] if "lang" in documents.columns else []))
    bands = BANDS | (bands or {})
    return map_arrow(docs, lambda b: _measure(b, ranks_path, piece_path, bands), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, script string, band string, n_tokens long, chars_per_token double, byte_share double, token_entropy double, reason string")


def op1(documents: DataFrame) -> DataFrame:
    return fertility_rules(documents, tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model"))


def keep_good(documents: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    The verdict is computed beside the row in the same pass, so nothing is joined or shuffled. Rows with null ids are judged like
    any other, null and empty texts go, repeated rows stay or go together; an empty table stays empty.
    """
    ranks, piece = tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model")
    schema = documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdict = next(iter(_measure(iter([batch.select([c for c in ("doc_id", "text", "lang") if c in batch.schema.names])]), ranks, piece, BANDS)))
            yield batch.filter(pa.array(verdict["kept"], pa.bool_()))

    return documents.mapInArrow(run, schema)
