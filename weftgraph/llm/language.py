"""Language identification with spans.

A word's script (Unicode ranges) narrows its candidate languages to those that
training saw in that script. Hashed character trigrams score the word for each
candidate; Viterbi over the words, with a penalty for a switch, labels spans of
mixed text. The document's language is the one with the most letters.

Trained on a bounded sample: about ``SAMPLE`` documents of each language, drawn
by id hash. All languages are learned; beyond ``FINE_LANGUAGES`` of them the
trigram slots get fewer, so that the tables stay of one size.

A language that isn't a candidate for a word's script gets no score there at all
and can't be the word's label; where no language was seen in a script, all are
candidates. Long texts are worked on in pieces of ``PIECE`` characters cut at
white space (a longer word counts as several), spans and labels run over all of
them. Null text or text without a letter is ``und`` with score 0 and no spans; so
is everything if there is nothing to learn from. Null languages don't train,
null ids neither. Repeated rows and rows that share an id are labelled each by
its own text; an empty table gives an empty result; other columns, whatever
their names, are not read, and ``keep_identified`` returns them as they are. A
tie goes to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, slices, spread, texts

#: Documents of a language that train, about.
SAMPLE = 2_000
BITS = 15
#: Up to so many languages trigrams have 2 ** BITS slots; each doubling from there on halves the slots, down to 2 ** LEAST_BITS.
FINE_LANGUAGES, LEAST_BITS = 256, 8
#: Scores of trigrams, or of a text's words, that are held at a time: trigrams (bytes of text) times languages.
SLOT_SCORES = 1 << 21
#: Nats that a switch of language costs.
SWITCH = 12.0
#: What stands for minus infinity: no label that isn't a candidate can make up for it.
NEVER = np.float32(-1e30)
#: Characters of a text that are scored at a time.
PIECE = 500_000
#: A language is a candidate in a script from this share of its letters on.
LEAST_SHARE = 0.01
#: First code points of script ranges (Unicode blocks); each range ends where the next begins.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "latin"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"),
    (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF00, "latin"), (0xFF65, "kana"), (0x10000, "other"), (0x20000, "han"),
]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_SPACES = np.array([9, 10, 11, 12, 13, 32], np.uint32)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: script number (255: no letter) and whether it ends a word."""
    script = np.full(0x110000, 255, np.uint8)
    ends = [start for start, _ in SCRIPTS[1:]] + [0x110000]
    letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    for (start, name), end in zip(SCRIPTS, ends, strict=True):
        script[start:end] = SCRIPT_NAMES.index(name)
    script[~letters] = 255
    space = np.zeros(0x110000, bool)
    space[_SPACES] = True
    return script, space


@dataclass
class Words:
    """The words of some texts: where each begins (among all characters), its text, its letters."""

    doc: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    slots: np.ndarray  # trigram slot of each letter, in order
    slot_word: np.ndarray
    offsets: np.ndarray  # of each text among all characters


def words_of(many: list[str]) -> Words:
    script, space = _tables()
    points = [np.frombuffer((t.lower() + "\n").encode("utf-32-le", "surrogatepass"), np.uint32) for t in many]
    # Lower-casing may lengthen a text; spans are then places in the lower-cased text.
    offsets = np.cumsum([0, *map(len, points)])
    every = np.concatenate([np.array([10], np.uint32), *points])
    gap = space[every]
    start = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    stop = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    kind = script[every]
    at = np.flatnonzero(kind != 255)
    word = np.searchsorted(start, at, side="right") - 1
    letters = np.bincount(word, minlength=len(start))
    votes = np.bincount(word * len(SCRIPT_NAMES) + kind[at], minlength=len(start) * len(SCRIPT_NAMES)).reshape(len(start), len(SCRIPT_NAMES))
    flat = np.where(gap, np.uint32(32), every)
    h = (flat[at - 1] * np.uint32(0x9E3779B1) + flat[at]) * np.uint32(0x85EBCA77) + flat[at + 1]
    slots = (h * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - BITS)
    doc = np.searchsorted(offsets, start - 1, side="right") - 1
    return Words(doc, start - 1, stop - 1, letters, votes.argmax(axis=1) if len(start) else np.zeros(0, np.int64), slots, word, offsets)


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # slot x language
    allowed: np.ndarray  # script x language: whether it is a candidate there

    @property
    def batch_bytes(self) -> int:
        """Texts that Viterbi runs over at a time: fewer if there are many languages."""
        return VITERBI_BYTES * 8 // max(8, len(self.languages))


def bits_for(languages: int) -> int:
    """Bits of a trigram slot."""
    return max(LEAST_BITS, BITS - max(0, (languages - 1) // FINE_LANGUAGES).bit_length())


def emissions(words: Words, model: Model) -> np.ndarray:
    """Log-likelihood of each word in each of its script's candidates, ``NEVER`` elsewhere; 0 for words without a letter."""
    out = np.zeros((len(words.start), len(model.languages)), np.float32)
    if not len(words.slots):
        return out
    at = np.flatnonzero(np.concatenate([[True], words.slot_word[1:] != words.slot_word[:-1]]))
    ends = np.append(at[1:], len(words.slots))
    own = words.slot_word[at]  # words with letters
    slots = words.slots >> np.uint32(BITS - bits_for(len(model.languages)))
    for script in np.unique(words.script[own]):
        candidates = np.flatnonzero(model.allowed[script])
        every = len(candidates) == len(model.languages)
        logs = model.logs if every else np.ascontiguousarray(model.logs[:, candidates])
        here = np.flatnonzero(words.script[own] == script)
        if not every:
            out[own[here]] = NEVER
        many = max(1, SLOT_SCORES // max(1, len(candidates)))
        sizes = np.cumsum(ends[here] - at[here])
        cuts = np.flatnonzero(np.diff(sizes // many, prepend=-1))  # whole words
        for low, high in zip(cuts, [*cuts[1:], len(here)], strict=True):
            part = here[low:high]
            if len(here) == len(at):  # one script only: its letters lie side by side
                first, taken = at[part] - at[part[0]], slots[at[part[0]] : ends[part[-1]]]
            else:
                n = ends[part] - at[part]
                first = np.cumsum(n) - n
                taken = slots[np.repeat(at[part] - first, n) + np.arange(int(n.sum()))]
            scores = np.add.reduceat(logs[taken], first, axis=0)
            if every:
                out[own[part]] = scores
            else:
                out[own[part][:, None], candidates[None, :]] = scores
    return out


def viterbi(scores: np.ndarray, first: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word; all texts take their k-th word at a time.

    ``scores`` holds the words of text after text, ``first`` where each text's
    begin and ``counts`` how many there are.
    """
    kind = np.int16 if scores.ndim < 2 or scores.shape[1] < 1 << 15 else np.int32
    best = np.zeros(len(scores), kind)
    if not len(scores):
        return best
    order = np.argsort(-counts, kind="stable")
    first, counts = first[order], counts[order]
    active = np.searchsorted(-counts, -np.arange(int(counts[0])), side="left")  # texts longer than k
    came = np.zeros(len(scores), kind)  # the language before, if the word switched
    stay = np.zeros(scores.shape, bool)
    v = np.zeros((len(order), scores.shape[1]), np.float32)
    for k in range(int(counts[0])):
        n = active[k]
        at = first[:n] + k
        if k:
            top = v[:n].argmax(axis=1)
            high = v[:n].max(axis=1) - switch
            came[at] = top
            stay[at] = v[:n] >= high[:, None]
            v[:n] = np.maximum(v[:n], high[:, None])
        v[:n] += scores[at]
        v[:n] -= v[:n].max(axis=1)[:, None]
    state = v.argmax(axis=1).astype(kind)
    for k in range(int(counts[0]) - 1, -1, -1):
        n = active[k]
        at = first[:n] + k
        best[at] = state[:n]
        if k:
            state[:n] = np.where(stay[at, state[:n]], state[:n], came[at])
    return best


def _count(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Letters by language, trigram slot and script of a task's documents."""
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch, "text"):
            langs = part.column("lang").to_pylist()
            many = texts(part.column("text"))
            for lang in set(langs):
                words = words_of([t for t, x in zip(many, langs, strict=True) if x == lang])
                grams[lang] = grams.get(lang, 0) + np.bincount(words.slots >> np.uint32(BITS - bits), minlength=1 << bits)
                scripts[lang] = scripts.get(lang, 0) + np.bincount(words.script, weights=words.letters, minlength=len(SCRIPT_NAMES)).astype(np.int64)
    for lang, counts in grams.items():
        every = np.concatenate([counts, scripts[lang]])
        at = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(every[at], pa.int64())], names=["lang", "slot", "n"])


def fit(docs: DataFrame) -> Model:
    """Learns from text and language of documents whose crc32 of the id modulo 4 is not 2."""
    usable = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(False)))
    sizes = usable.groupBy("lang").count().collect()
    if not sizes:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), np.float32))
    bits = bits_for(len(sizes))
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, SAMPLE / r["count"])) for r in sizes], "of string, share double")
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(3), "doc_id"), 33).cast("double") / float(1 << 31)
    drawn = usable.join(F.broadcast(share), F.col("lang") == F.col("of")).where(unit < F.col("share"))
    counted = drawn.select("lang", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lambda batches: _count(batches, bits), "lang string, slot int, n long")
    table = counted.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()  # at most languages x slots
    languages = sorted(r["lang"] for r in sizes)
    place = {x: i for i, x in enumerate(languages)}
    counts = np.zeros(((1 << bits) + len(SCRIPT_NAMES), len(languages)))
    counts[table.column("slot").to_numpy(), [place[x] for x in table.column("lang").to_pylist()]] = table.column("n").to_numpy()
    grams, scripts = counts[: 1 << bits], counts[1 << bits :]
    logs = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * (1 << bits)))
    allowed = scripts >= LEAST_SHARE * np.maximum(1, scripts.sum(axis=0))
    # A script that no language was seen in leaves all as candidates.
    allowed[~allowed.any(axis=1)] = True
    return Model(languages, logs.astype(np.float32), allowed)


def pieces_of(text: str, most: int = PIECE) -> list[str]:
    """A text in pieces of at most ``most`` characters, cut after white space where there is some."""
    out, at = [], 0
    while len(text) - at > most:
        stop = next((i + 1 for i in range(at + most - 1, at + most // 2, -1) if text[i] in " \t\n\v\f\r"), at + most)
        out.append(text[at:stop])
        at = stop
    return [*out, text[at:]]


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))


def _placed(pieces: list[str]) -> Iterator[tuple[int, str]]:
    """Each piece with its place among the lower-cased characters."""
    at = 0
    for piece in pieces:
        yield at, piece
        at += len(piece.lower()) if len(pieces) > 1 else 0


def label(many: list[str], model: Model) -> tuple[list[str], list[float], list[list[dict]]]:
    """Language, its share of the letters, and the spans of each text."""
    cut = [(i, at, piece) for i, text in enumerate(many) for at, piece in _placed(pieces_of(text))]
    parts, at = [], 0
    while at < len(cut):  # scores in small groups, Viterbi over all
        stop, held = at, 0
        while stop < len(cut) and (stop == at or held + len(cut[stop][2]) < PIECE):
            held += len(cut[stop][2])
            stop += 1
        words = words_of([piece for _, _, piece in cut[at:stop]])
        of, moved = (np.array([c[k] for c in cut[at:stop]], np.int64) for k in (0, 1))
        moved = moved[words.doc] - words.offsets[words.doc]
        parts.append((of[words.doc], words.start + moved, words.stop + moved, words.letters, emissions(words, model)))
        at = stop
    doc, start, stop, letters, scores = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 5
    counts = np.bincount(doc, minlength=len(many))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    best = viterbi(scores, first, counts) if model.languages and len(doc) else np.zeros(len(doc), np.int16)
    width = max(1, len(model.languages))
    weight = np.bincount(doc * width + best, weights=letters, minlength=len(many) * width).reshape(len(many), width)
    total = weight.sum(axis=1)
    top = weight.argmax(axis=1)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (best[1:] != best[:-1])]) if len(doc) else np.zeros(0, bool)
    begins = np.flatnonzero(new)
    ends = np.concatenate([begins[1:], [len(doc)]]) - 1 if len(begins) else begins
    spans: list[list[dict]] = [[] for _ in many]
    if model.languages:
        for b, e in zip(begins, ends, strict=True):
            if total[doc[b]]:
                spans[doc[b]].append({"start": int(start[b]), "stop": int(stop[e]), "lang": model.languages[best[b]]})
    known = (total > 0) & bool(model.languages)
    langs = [model.languages[t] if k else "und" for t, k in zip(top, known, strict=True)]
    shares = [float(weight[i, t] / total[i]) if known[i] else 0.0 for i, t in enumerate(top)]
    return langs, shares, spans


def _label_batch(batch: pa.RecordBatch, model: Model) -> tuple[list[str], list[float], list]:
    return label(texts(batch.column("text")), model)


#: Texts that Viterbi runs over at a time, in bytes.
VITERBI_BYTES = 4 << 20


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` (its share of the letters) and ``spans`` of every row."""
    known = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", known.value.batch_bytes):
                langs, shares, spans = _label_batch(part, known.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, _SPAN)], names=["doc_id", "held_out", "lang_pred", "score", "spans"])

    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    rows = spread(docs.select("doc_id", "text")).select("doc_id", "text", held.alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<start:int,stop:int,lang:string>>")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` mostly in one learned language, in all their columns; no shuffle."""
    known = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", known.value.batch_bytes):
                langs, shares, _ = _label_batch(part, known.value)
                yield part.filter(pa.array([x != "und" and s >= least for x, s in zip(langs, shares, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
