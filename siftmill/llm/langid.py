"""Languages of documents and of their segments: Bayesian fusion of text, label and host evidence.

Python works on blocks of many texts at once: code points in one array, words coded by hash, each distinct word scored
once, sentences summed by ``numpy.add.reduceat``, and switches of language searched in all sentences side by side.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.session import discard, materialise, small

# The languages' codes and the ways a label may name them.
NAMES = {
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
    "ru": ("ru", "rus", "russian", "русский"),
    "ja": ("ja", "jpn", "japanese", "日本語"),
}
# The language that an address suffix suggests.
SUFFIXES = {"uk": "en", "us": "en", "au": "en", "ie": "en", "es": "es", "mx": "es", "ar": "es", "pt": "pt", "br": "pt", "fr": "fr", "de": "de", "at": "de", "it": "it", "nl": "nl", "ru": "ru", "jp": "ja"}
#: Longest character n-gram, weight of whole words against n-grams, least likelihood ratio that one word can give.
ORDER, WORD_SHARE, WORD_FLOOR = 4, 0.5, -7.0
#: Cost in nats of a change of language inside a sentence, and of a sentence that differs from its document (under
#: equal priors of the other languages).
SWITCH, STRAY = 12.0, 5.0
#: Sentences of so many words or fewer aren't searched for a change of language: two changes can't pay.
SPLIT_WORDS = 5
#: A stray piece of so few words inside a sentence is taken for a name (scripts without blanks aside).
NAME_WORDS = 3
#: Above so many words, a sentence counts once for each capital letter on a word that begins sentences: it lost its stops.
GLUED_WORDS = 9
#: Words kept with their likelihoods per process before the store is emptied; characters of one block.
CACHE, BLOCK = 200_000, 1 << 20
#: Strength of the document's own source over all documents, and of a host over its source, in documents.
SOURCE_WEIGHT, HOST_WEIGHT = 20.0, 10.0
#: Effective share of a text's log-likelihood: its words aren't independent.
TEMPER = 0.25
#: Least prior of a stray sentence's language, and steps of a stored score in a nat.
LEAST_PRIOR, STEPS = 1e-3, 16

_KANA = "\u3040-\u30ff\u3400-\u9fff々〆"
# A word; scripts written without blanks are taken three characters at a time.
_WORD = re.compile(rf"[{_KANA}]{{1,3}}|[^\W\d_{_KANA}]+(?:['’][^\W\d_{_KANA}]+)*")
_LETTER, _WIDE, _MARK, _VOICED, _APOSTROPHE, _STOP, _WIDE_STOP, _LINE, _CLOSER, _AFTER, _UPPER, _LOWER = (1 << i for i in range(12))


def label_language(label: Column | str) -> Column:
    """The language a label names in any spelling, case or region, else null."""
    plain = F.regexp_extract(F.lower(F.regexp_replace(label, r"^\s+|\s+$", "")), r"^([^\s_\-]+)", 1)
    return F.try_element_at(F.create_map(*(F.lit(x) for code, names in NAMES.items() for n in names for x in (n, code))), plain)


def markup_language(text: Column | str) -> Column:
    """The language declared by the first lang attribute of a text's markup, else null."""
    return label_language(F.regexp_extract(text, r"""(?i)<[a-z][^<>]*?\s(?:xml:)?lang\s*=\s*["']?([a-z_-]+)""", 1))


def address_language(text: Column | str) -> Column:
    """The language suggested by the country suffix of the first web address in a text, else null."""
    found = F.lower(F.regexp_extract(text, r"(?i)https?://[a-z0-9.-]+\.([a-z]{2})(?![a-z0-9.-])", 1))
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in SUFFIXES.items() for x in pair)), found)


def _bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def _flags(c: str) -> int:
    """What a character can be in a text, as bits."""
    kind, wide = unicodedata.category(c), re.match(f"[{_KANA}]", c) is not None
    letter = c.isalnum() and kind != "Nd"
    plain = "a" <= c <= "z" or "à" <= c <= "ÿ" or "а" <= c <= "я" or c == "ё"
    closer = c in "\"»”’)"
    return (
        (_LETTER if letter and not wide else 0) | (_WIDE if wide else 0) | (_MARK if kind == "Mn" and not wide and not "\ufe00" <= c <= "\ufe0f" else 0)
        | (_VOICED if c in "\u3099\u309a" else 0) | (_APOSTROPHE if c in "'’" else 0) | (_STOP if c in ".!?…" else 0) | (_WIDE_STOP if c in "。！？" else 0)
        | (_LINE if c == "\n" else 0) | (_CLOSER if closer else 0) | (_AFTER if c.isspace() or closer or c == "<" or letter and not plain else 0)
        | (_UPPER if c.isupper() else 0) | (_LOWER if c.islower() else 0)
    )


class _Characters:
    """Flags and lower case of code points: the basic plane as a table, others as they come."""

    def __init__(self) -> None:
        basic = [chr(i) for i in range(1 << 16)]
        self.flags = np.array([_flags(c) for c in basic], np.int16)
        self.lower = np.array([ord(x) if len(x := c.lower()) == 1 else i for i, c in enumerate(basic)], np.uint32)

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high = codes > 0xFFFF
        if not high.any():
            return self.flags[codes], self.lower[codes]
        basic = np.where(high, 0, codes)
        flags, lower = self.flags[basic], self.lower[basic]
        unique, at = np.unique(codes[high], return_inverse=True)
        flags[high] = np.array([_flags(chr(c)) for c in unique], np.int16)[at]
        lower[high] = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in unique], np.uint32)[at]
        return flags, lower


def _starts(flag: np.ndarray) -> np.ndarray:
    """Where runs of a flag begin, as a flag."""
    out = flag.copy()
    out[1:] &= ~flag[:-1]
    return out


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between offsets; 0 where two offsets are equal."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), values.dtype)
    there = offsets[1:] > offsets[:-1]
    if there.any():
        out[there] = np.add.reduceat(values, offsets[:-1][there], axis=0)
    return out


def _without_tags(text: str) -> str:
    """Every tag, from a < to the next >, becomes line ends of the same length."""
    at = text.find("<")
    if at < 0:
        return text
    out, done = [], 0
    while at >= 0 and (end := text.find(">", at)) >= 0:
        out += [text[done:at], "\n" * (end + 1 - at)]
        done = end + 1
        at = text.find("<", done)
    return "".join([*out, text[done:]])


class TextModel:
    """Word and character n-gram likelihoods of each language, from a bounded sample of labelled sentences."""

    def __init__(self, sample: Iterable[tuple[str, str]], languages: Sequence[str]) -> None:
        self.languages = list(languages)
        n = len(self.languages)
        words = [Counter() for _ in range(n)]
        grams = [Counter() for _ in range(n)]
        self.starters: list[set[str]] = [set() for _ in range(n)]
        for lang, text in sample:
            if lang not in self.languages or not text:
                continue
            i = self.languages.index(lang)
            text = unicodedata.normalize("NFC", text).lower()
            # Each sentence also counts without accents, for texts that lost them.
            for form in {text, _bare(text)}:
                found = _WORD.findall(form)
                words[i].update(found)
                self.starters[i].update(found[:1])
                for w in found:
                    grams[i].update(self._grams(w))
        self.words = self._logs(words, 0.1)
        self.grams = [self._logs([Counter({g: c for g, c in x.items() if len(g) == k}) for x in grams], 0.5) for k in range(1, ORDER + 1)]
        self.characters = _Characters()
        self._forget()

    @staticmethod
    def _grams(word: str) -> Iterator[str]:
        padded = f"^{word}$"
        for k in range(1, ORDER + 1):
            for at in range(len(padded) - k + 1):
                yield padded[at : at + k]

    @staticmethod
    def _logs(counts: list[Counter], extra: float) -> tuple[dict[str, int], np.ndarray]:
        """Numbers by key, and a row of log-probabilities for each number; the last row is that of an unseen key."""
        keys = sorted(set().union(*counts))
        totals = np.array([sum(c.values()) for c in counts], float) + extra * (len(keys) + 1)
        rows = np.array([[c[k] for c in counts] for k in keys] + [[0] * len(counts)], float)
        return {k: i for i, k in enumerate(keys)}, np.log((rows + extra) / totals)

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.scores = np.zeros((1024, len(self.languages)), np.float32)
        self.begins = np.zeros((1024, len(self.languages)), bool)

    def word(self, w: str) -> np.ndarray:
        """Log-likelihood ratios of a lower-cased word to its best language, per language."""
        padded = f"^{w}$"
        # The mean over orders of the n-grams' sums, each scaled to the word's own length.
        total = np.zeros(len(self.languages))
        for k in range(2, ORDER + 1):
            number, logs = self.grams[k - 1]
            unseen = len(logs) - 1
            total += logs[[number.get(padded[a : a + k], unseen) for a in range(max(1, len(padded) - k + 1))]].sum(0)
        total /= ORDER - 1
        number, logs = self.words
        if w in number:
            total = (1 - WORD_SHARE) * total + WORD_SHARE * 2 * logs[number[w]]
        return np.maximum(total - total.max(), WORD_FLOOR)

    def _code(self, hashes: np.ndarray, first: np.ndarray, end: np.ndarray, text: str) -> np.ndarray:
        """Rows of the words' scores; new words, known by their place in ``text``, are scored once."""
        if len(self.known) > CACHE:
            self._forget()
        unique, place, at = np.unique(hashes, return_index=True, return_inverse=True)
        rows = np.empty(len(unique), np.int64)
        for i, h in enumerate(unique.tolist()):
            row = self.known.get(h)
            if row is None:
                row = self.known[h] = len(self.known)
                if row == len(self.scores):
                    self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                    self.begins = np.concatenate([self.begins, np.zeros_like(self.begins)])
                w = unicodedata.normalize("NFC", text[first[place[i]] : end[place[i]]]).lower()
                self.scores[row] = self.word(w)
                self.begins[row] = [w in s for s in self.starters]
            rows[i] = row
        return rows[at]

    @staticmethod
    def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of every word."""
        letter, wide = (flags & _LETTER) > 0, (flags & _WIDE) > 0
        like = letter | ((flags & _MARK) > 0)  # a mark goes with the letters before it
        runs = np.cumsum(_starts(like)) - 1
        before = np.cumsum(letter) - letter
        like &= letter | (before > before[np.flatnonzero(_starts(like))][np.maximum(runs, 0)] if like.any() else False)
        join = ((flags & _APOSTROPHE) > 0)
        join[0] = join[-1] = False
        join[1:-1] &= like[:-2] & letter[2:]
        like |= join
        base = wide & ~((flags & _VOICED) > 0)
        start = _starts(like) | _starts(wide)
        if wide.any():
            count = np.cumsum(base) - base
            run = np.cumsum(_starts(wide)) - 1
            start |= base & ((count - count[np.flatnonzero(_starts(wide))][np.maximum(run, 0)]) % 3 == 0)
        inside = like | wide
        last = inside.copy()
        last[:-1] &= ~inside[1:] | start[1:]
        return np.flatnonzero(start), np.flatnonzero(last) + 1

    @staticmethod
    def _stops(flags: np.ndarray) -> np.ndarray:
        """Ends of sentences: behind stops, wide stops and line ends, and the quotes or brackets that close there."""
        n = len(flags)
        following = np.append(flags[1:], np.int16(_AFTER))
        stop = ((flags & _STOP) > 0) & ((following & (_STOP | _AFTER)) == _AFTER)
        for kind in (_WIDE_STOP, _LINE):
            stop |= ((flags & kind) > 0) & ((following & kind) == 0)
        ends = np.flatnonzero(stop) + 1
        other = np.append(np.flatnonzero((flags & _CLOSER) == 0), n)
        return np.unique(other[np.searchsorted(other, ends)])

    def _paths(self, scores: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The best languages of all words of sentences, each given by its first row and size, with a cost per change."""
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        active = np.searchsorted(-size, -np.arange(size[0]) - 1, "right")  # sentences of more than t words
        best, back = scores[first].astype(np.float32), []
        every = np.arange(scores.shape[1], dtype=np.int8)
        for t in range(1, size[0]):
            b = best[: active[t]]
            top = b.argmax(1)
            leap = (b[np.arange(len(b)), top] - SWITCH)[:, None]
            stay = b >= leap
            back.append(np.where(stay, every, top[:, None].astype(np.int8)))
            best[: active[t]] = np.where(stay, b, leap) + scores[first[: active[t]] + t]
        here, path = best.argmax(1), np.zeros(len(scores), np.int8)
        for t in range(size[0] - 1, -1, -1):
            n = active[t]
            path[first[:n] + t] = here[:n]
            if t:
                here[:n] = back[t - 1][np.arange(n), here[:n]]
        return path

    def _block(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Pieces of several texts that hold words: (text, begin, end, words, sentences, whole, scores), in order.

        A piece is a sentence, or a run of one language in a sentence (or in several that lost their stops).
        ``whole`` says that it is all of its sentence.
        """
        texts = [_without_tags(t) for t in texts]
        text = "\n".join([*texts, ""])
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        flags, lower = self.characters.of(codes)
        first, end = self._spans(flags)
        if not len(first):
            none = np.zeros(0, np.int64)
            return none, none, none, none, none, none.astype(bool), np.zeros((0, len(self.languages)), np.float32)
        n_words = len(first)
        # Polynomial hashes of the lower-cased words, modulo 2 ** 64.
        size = end - first
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        power = np.cumprod(np.append(np.uint64(1), np.full(size.max() - 1, 0x9E3779B97F4A7C15, np.uint64)))
        letters = np.repeat(first, size) + inside
        hashes = np.add.reduceat((lower[letters].astype(np.uint64) + np.uint64(1)) * power[inside], np.cumsum(size) - size)
        rows = self._code(hashes, first, end, text)
        scores = self.scores[rows]

        stops = self._stops(flags)
        sentence = np.searchsorted(stops, first, "right")
        new = np.append(True, sentence[1:] != sentence[:-1])
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, n_words))
        searched = (length > SPLIT_WORDS) & (np.add.reduceat(scores, at, axis=0).max(1) < -SWITCH)
        if searched.any():
            path = self._paths(scores, at[searched], length[searched])
            new[1:] |= path[1:] != path[:-1]  # a path is 0 outside the sentences searched, whose first words are new anyway
            inner = np.repeat(searched, length)
            new &= inner | np.append(True, sentence[1:] != sentence[:-1])
        at = np.flatnonzero(new)
        words = np.diff(np.append(at, n_words))
        total = np.add.reduceat(scores, at, axis=0)

        part = sentence[at]
        opens, closes = np.append(True, part[1:] != part[:-1]), np.append(part[1:] != part[:-1], True)
        edges = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
        doc = np.searchsorted(edges, first[at], "right") - 1
        begin = np.where(opens, np.maximum(np.append(0, stops)[part], edges[doc]), first[at])
        finish = np.where(closes, np.minimum(np.append(stops, len(text))[part], edges[doc + 1] - 1), np.append(first[at][1:], 0))

        sentences = np.ones(len(at), np.int64)
        if (words > GLUED_WORDS).any():
            capital = ((flags[first] & _UPPER) > 0) & (np.add.reduceat(((flags[letters] & _LOWER) > 0).astype(np.int32), np.cumsum(size) - size) > 0)
            counted = capital & self.begins[rows, np.repeat(total.argmax(1), words)]
            sentences = np.where(words > GLUED_WORDS, np.maximum(1, np.add.reduceat(counted.astype(np.int64), at)), 1)
        return doc, begin - edges[doc], finish - edges[doc], words, sentences, opens & closes, total

    def pieces(self, texts: Sequence[str | None]) -> tuple[np.ndarray, ...]:
        """As ``_block``, for any number of texts of any length; a text above ``BLOCK`` is cut behind a sentence."""
        parts: list[tuple[int, int, str]] = []
        for i, t in enumerate(texts):
            at = 0
            while t and len(t) - at > BLOCK:
                # A cut behind the last line end or stop with a blank in the block, else before the next one.
                places = [p for mark in ("\n", ". ", "! ", "? ", "。") if (p := t.rfind(mark, at, at + BLOCK)) >= 0] or [p for mark in ("\n", ". ", "! ", "? ", "。") if (p := t.find(mark, at + BLOCK)) >= 0][:1]
                if not places:
                    break
                parts.append((i, at, t[at : max(places) + 1]))
                at = max(places) + 1
            if t:
                parts.append((i, at, t[at:] if at else t))
        blocks, held, room = [], [], 0
        for p in [*parts, None]:
            if held and (p is None or room + len(p[2]) > BLOCK):
                doc, begin, end, *rest = self._block([x for _, _, x in held])
                text, offset = np.array([i for i, _, _ in held]), np.array([a for _, a, _ in held])
                blocks.append((text[doc], begin + offset[doc], end + offset[doc], *rest))
                held, room = [], 0
            if p is not None:
                held.append(p)
                room += len(p[2]) + 1
        return tuple(np.concatenate(c) for c in zip(*blocks)) if blocks else self._block([""])

    def document(self, text: str) -> tuple[np.ndarray, list[tuple[int, int, int, int, float]]]:
        """Scores of a text and its segments under equal priors: (first character, end, language, sentences, confidence)."""
        doc, begin, end, words, sentences, whole, scores = self.pieces([text])
        n = len(self.languages)
        offsets = np.array([0, len(doc)])
        found = decide(offsets, begin, end, words, sentences, whole, scores.astype(float), np.zeros((1, n)), self.languages)
        return scores.sum(0), list(zip(*(found[c].tolist() for c in ("begin", "end", "lang", "sentences", "confidence"))))


def robust(scores: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Scores of whole documents in which any piece may be a stray of another language, at its cost."""
    return _sums(np.maximum(scores, scores.max(1, keepdims=True) - STRAY) if len(scores) else scores, offsets)


def _shares(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def decide(offsets: np.ndarray, begin: np.ndarray, end: np.ndarray, words: np.ndarray, sentences: np.ndarray, whole: np.ndarray, scores: np.ndarray, priors: np.ndarray, languages: Sequence[str]) -> dict[str, np.ndarray]:
    """Segments and languages of documents from their pieces' scores and the documents' log-priors.

    The main language has the highest posterior, any piece being free to be a stray. A piece's language has the
    highest posterior given the main one: a stray pays ``STRAY``, less if the document's priors (of label, markup,
    address, host) speak for its language, more if they speak against it. A document whose pieces agree takes the
    language of highest posterior of the whole; so do its pieces.
    """
    n, k = priors.shape
    doc = np.repeat(np.arange(n), np.diff(offsets))
    main = (TEMPER * robust(scores, offsets) + priors).argmax(1)
    others = priors.copy()
    others[np.arange(n), main] = -np.inf
    with np.errstate(divide="ignore"):
        cost = STRAY - np.log(np.maximum(_shares(others), LEAST_PRIOR) * max(1, k - 1))
    cost[np.arange(n), main] = 0
    fused = scores - cost[doc]
    lang = fused.argmax(1) if len(fused) else np.zeros(0, np.int64)
    short = ~whole & (words <= NAME_WORDS) & (lang != (languages.index("ja") if "ja" in languages else -1))
    lang = np.where(short, main[doc], lang)
    sure = _shares(TEMPER * fused)[np.arange(len(lang)), lang] if len(lang) else np.zeros(0)

    counts, room = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)
    np.add.at(counts, (doc, lang), sentences)
    np.add.at(room, (doc, lang), end - begin)
    kinds = (counts > 0).sum(1)
    whole_post = TEMPER * _sums(scores, offsets) + priors
    best = whole_post.argmax(1)
    alone = kinds == 1
    top = np.where(alone, best, (counts * (1 << 40) + room).argmax(1))
    if alone.any():
        lang = np.where(alone[doc], best[doc], lang)
        sure = np.where(alone[doc], _shares(whole_post).max(1)[doc], sure)
        one = np.flatnonzero(alone)
        counts[one] = counts[one].sum(1, keepdims=True) * (np.arange(k) == best[one][:, None])
    many = counts >= 2
    single = many.sum(1) < 2
    chosen = np.where(many.any(1), many.argmax(1), top)
    listed = np.where(single[:, None], (np.arange(k) == chosen[:, None]) & (kinds > 0)[:, None], many)
    counts = np.where(single[:, None], counts.sum(1, keepdims=True), counts)
    own = (lang == top[doc]) * sentences
    mean = _sums(own * sure, offsets) / np.maximum(1, _sums(own, offsets))

    new = np.append(True, (doc[1:] != doc[:-1]) | (lang[1:] != lang[:-1])) if len(doc) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    edge = np.append(at, len(doc))
    owner = doc[at]
    n_sentences = _sums(sentences, edge)
    ends = end[edge[1:] - 1] if len(at) else end[:0]
    ends = np.where(np.append(owner[1:] == owner[:-1], False), np.append(begin[at][1:], 0), ends) if len(at) else ends
    return {
        "begin": begin[at], "end": ends, "lang": lang[at], "sentences": n_sentences, "confidence": _sums(sentences * sure, edge) / np.maximum(1, n_sentences),
        "segments": np.append(0, np.cumsum(np.bincount(owner, minlength=n))), "top": top, "there": kinds > 0, "mean": mean, "listed": listed, "counts": counts,
    }


#: Columns of a scored document that name a language.
EVIDENCE = ("label_lang", "markup", "address")
SCORED = "main string, begins array<int>, ends array<int>, words array<int>, sentences array<int>, wholes array<boolean>, scores array<smallint>"
DECIDED = "label_lang string, lang string, confidence double, langs array<struct<lang:string,sentences:int>>, segments array<struct<begin:int,end:int,lang:string,sentences:int,confidence:double>>"

_models: dict[int, TextModel] = {}


def _model(sample: list[tuple[str, str]], languages: list[str]) -> TextModel:
    """The model of a sample, learnt once per process."""
    key = hash((tuple(sample), tuple(languages)))
    if key not in _models:
        _models.clear()
        _models[key] = TextModel(sample, languages)
    return _models[key]


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _score(sample: list[tuple[str, str]], languages: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, names = _model(sample, languages), np.array(languages, object)
        for batch in batches:
            n = batch.num_rows
            doc, begin, end, words, sentences, whole, scores = model.pieces(batch.column(batch.num_columns - 1).to_pylist())
            offsets = np.append(0, np.cumsum(np.bincount(doc, minlength=n)))
            main = pa.array(names[robust(scores.astype(float), offsets).argmax(1)], pa.string(), mask=offsets[1:] == offsets[:-1])
            steps = np.clip(np.rint(scores * STEPS), -(1 << 15), 0).astype(np.int16)
            found = [_lists(offsets, pa.array(x.astype(np.int32))) for x in (begin, end, words, sentences)]
            yield pa.record_batch([*batch.columns[:-1], main, *found, _lists(offsets, pa.array(whole)), _lists(offsets * len(languages), pa.array(steps.ravel()))], names=[*batch.schema.names[:-1], "main", "begins", "ends", "words", "sentences", "wholes", "scores"])

    return run


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _decide(languages: list[str], right: dict[str, float]):
    """Fuses the scores of a batch of documents with their evidence and priors."""
    k = len(languages)
    says = {}
    for c in EVIDENCE:
        table = np.full((k + 1, k), math.log((1 - right[c]) / max(1, k - 1)))
        np.fill_diagonal(table, math.log(right[c]))
        table[k] = 0  # silent
        says[c] = table

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, values = np.array(languages, object), pa.array(languages, pa.string())
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            priors = np.log(_flat(column("prior")).reshape(-1, k))
            for c in EVIDENCE:
                priors += says[c][pc.fill_null(pc.index_in(column(c), value_set=values), k).to_numpy(zero_copy_only=False)]
            offsets = column("begins").offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            f = decide(offsets, *(_flat(column(c)) for c in ("begins", "ends", "words", "sentences", "wholes")), _flat(column("scores")).reshape(-1, k) / STEPS, priors, languages)
            ints = lambda x: pa.array(x.astype(np.int32))
            # The languages of a document, those of most sentences first.
            who, which = np.nonzero(f["listed"])
            order = np.lexsort((which, -f["counts"][who, which], who))
            who, which = who[order], which[order]
            langs = pa.StructArray.from_arrays([pa.array(names[which], pa.string()), ints(f["counts"][who, which])], ["lang", "sentences"])
            segments = pa.StructArray.from_arrays([ints(f["begin"]), ints(f["end"]), pa.array(names[f["lang"]], pa.string()), ints(f["sentences"]), pa.array(f["confidence"])], ["begin", "end", "lang", "sentences", "confidence"])
            none = ~f["there"]
            yield pa.record_batch(
                [column("item"), column("label_lang"), pa.array(names[f["top"]], pa.string(), mask=none), pa.array(f["mean"], mask=none), _lists(np.append(0, np.cumsum(np.bincount(who, minlength=batch.num_rows))), langs), _lists(f["segments"], segments)],
                names=["item", "label_lang", "lang", "confidence", "langs", "segments"],
            )

    return run


def identify(df: DataFrame, item: str, text: str, label: str, source: str, host: str, sample: DataFrame, *, sample_rows: int = 5_000, languages: Sequence[str] = tuple(NAMES)) -> DataFrame:
    """Languages of documents: item, label_lang, lang, confidence, langs (with sentences each), segments.

    ``langs`` holds every language with two sentences or more; if there is none such, or only single sentences
    differ, the main language alone. ``segments`` has the stretches of one language (character positions, language,
    sentences, confidence). ``lang`` is the language of most sentences, ``confidence`` its posterior or, in a mixed
    document, the mean posterior of its sentences.

    Method: text likelihoods come from words and character n-grams, learnt from at most ``sample_rows`` rows (by
    hash order) of ``sample`` (lang, text); the label, a language declared in the text's markup and the suffix of an
    address in it each give a likelihood from how often they are right; host and source give a prior, smoothed from
    all documents over the source to the host. All of these come from grouped aggregation over all documents. The
    posterior is the product, for the document and, given its main language, for each of its pieces (``decide``).

    Defined cases: null and empty texts and texts without letters have lang null, no segments, confidence null; null
    source or host forms a group of its own; labels are read by ``label_language``, anything else counts as missing;
    repeated texts are documents of their own; whole texts are read; an empty table gives no rows.
    """
    languages = list(languages)
    if sample.count() > sample_rows:
        sample = sample.orderBy(F.xxhash64("lang", "text"), "lang", "text").limit(sample_rows)
    learnt = [(r.lang, r.text) for r in sample.select("lang", "text").dropna().collect()]
    kind = df.schema[item].dataType.simpleString()
    t = F.col(text)
    # The cheap tests spare most texts the patterns, which can't match without these characters.
    markup, address = F.when(t.contains("<"), markup_language(t)), F.when(t.contains("://"), address_language(t))
    rows = df.select(F.col(item).alias("item"), label_language(label).alias("label_lang"), markup.alias("markup"), address.alias("address"), F.col(source).cast("string").alias("s"), F.col(host).cast("string").alias("h"), t.alias("text"))
    scored = materialise(rows.mapInArrow(_score(learnt, languages), f"item {kind}, label_lang string, markup string, address string, s string, h string, {SCORED}"))

    # How often labels are right, and how the languages are spread: all documents, source, host in source.
    known = scored.where("main is not null")
    by_host = materialise(known.groupBy("s", "h", "main").agg(F.count(F.lit(1)).alias("c"), *(f(c) for c in EVIDENCE for f in (lambda c: F.count_if(F.col(c) == F.col("main")).alias(f"right_{c}"), lambda c: F.count(c).alias(f"all_{c}")))))
    sums = [f"{k}_{c}" for c in EVIDENCE for k in ("right", "all")]
    overall = {r.main: r for r in by_host.groupBy("main").agg(F.sum("c").alias("c"), *(F.sum(c).alias(c) for c in sums)).collect()}
    total = sum(r.c for r in overall.values()) + len(languages)
    everywhere = F.array(*(F.lit(((overall[l].c if l in overall else 0) + 1) / total) for l in languages))
    right = {c: (sum(r[f"right_{c}"] for r in overall.values()) + 1) / (sum(r[f"all_{c}"] for r in overall.values()) + 2) for c in EVIDENCE}

    def spread(keys: list[str]) -> DataFrame:
        counts = by_host.groupBy(*keys).agg(*(F.sum(F.when(F.col("main") == l, F.col("c")).otherwise(0)).cast("double").alias(f"c{i}") for i, l in enumerate(languages)))
        return counts.select(*keys, F.array(*(f"c{i}" for i in range(len(languages)))).alias("n"))

    smooth = lambda n, prior, weight: F.zip_with(n, prior, lambda x, p: (x + p * weight) / (F.aggregate(n, F.lit(0.0), lambda a, y: a + y) + weight))
    of_source = spread(["s"]).select(F.col("s").alias("s1"), smooth(F.col("n"), everywhere, SOURCE_WEIGHT).alias("p"))
    of_host = spread(["s", "h"]).join(small(of_source), F.col("s").eqNullSafe(F.col("s1"))).select(F.col("s").alias("s1"), F.col("h").alias("h1"), smooth(F.col("n"), F.col("p"), HOST_WEIGHT).alias("prior"))
    of_host = materialise(of_host)
    discard(by_host)
    joined = scored.join(small(of_host), F.col("s").eqNullSafe(F.col("s1")) & F.col("h").eqNullSafe(F.col("h1")), "left")
    fused = joined.select("item", *EVIDENCE, F.coalesce("prior", everywhere).alias("prior"), "begins", "ends", "words", "sentences", "wholes", "scores")
    return fused.mapInArrow(_decide(languages, right), f"item {kind}, {DECIDED}").withColumnRenamed("item", item)
