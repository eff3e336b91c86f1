"""Personal values in free text: found by a skip-chain conditional random field, replaced by typed placeholders.

A text is cut into tokens: words, punctuation, addresses in a network, numbers with their grouping and runs that mix
letters and digits. No format of a country is known to the tokenizer. The field labels tokens as beginning or continuing a value of a
kind. Equal and similar words of a text (a name said twice, a name and the mail address made of it) are joined by
skip edges, so that what is clear in one place helps in the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from pinloom.llm import crf
from pinloom.llm.function_words import word_class
from pinloom.llm.personal_training import training_texts
from pinloom.partitions import spread

KINDS = ("email", "phone", "id_number", "address", "name")
LABELS = ["O", "B-email", "B-phone", "I-phone", "B-id_number", "I-id_number", "B-address", "I-address", "B-name", "I-name"]

GAP = r"[     ]"
SIGN = rf"(?:@|{GAP}?[\[({{]{GAP}?at{GAP}?[\])}}]{GAP}?)"
DOT = rf"(?:\.|{GAP}?[\[({{]{GAP}?dot{GAP}?[\])}}]{GAP}?|{GAP}dot{GAP})"
HOST = rf"[^\W_](?:[\w-]*[^\W_])?(?:{DOT}[^\W_](?:[\w-]*[^\W_])?)*{DOT}[^\W\d_]{{2,}}"
MAIL = rf"""(?P<url>\w+://\S+)
    |(?P<mail>(?<![\w.+-])[\w](?:[\w.+'’-]*[\w])?(?:{SIGN}{HOST}|{GAP}at{GAP}{HOST}(?!(?:{SIGN}|{GAP}at{GAP}){HOST}))(?![\w@]))
    |"""
OTHER = rf"""(?P<mixed>(?<!\w)(?=[\w./-]{{0,40}}?\d)(?=[\w./-]{{0,40}}?[^\W\d_])(?:\w{{1,30}}[-./]){{0,8}}\w{{1,30}}(?!\w))
    |(?P<number>(?:\+|\((?=\+?\d+\){GAP}?-?\d)\+?)?\d+(?:\)?{GAP}?\(\d+\)(?:{GAP}|-)?\d+|\)(?:{GAP}|-)?\d+|[-./]\d+|{GAP}\d+)*)
    |(?P<word>[^\W\d_]+(?:['’-][^\W\d_]+)*)
    |(?P<mark>\S)"""
TOKEN = regex.compile(MAIL + OTHER, regex.VERBOSE | regex.IGNORECASE)
# A text without an address takes a shorter way: words that nothing joins to what follows are tried first.
PLAIN = regex.compile(r"(?P<w>[^\W\d_]+(?:['’-][^\W\d_]+)*(?![\w/'’-]|\.\w))|" + OTHER.replace(" ", "").replace("\n", "").replace(GAP.replace(" ", ""), GAP), regex.IGNORECASE)
ADDRESS = re.compile(rf"@|://|[\[({{]{GAP}?at{GAP}?[\])}}]|{GAP}at{GAP}[^\W_][\w-]*(?:\.|{GAP}?[\[({{]{GAP}?dot|{GAP}dot)", re.IGNORECASE)
LOCAL_END, LOCAL_CUT = regex.compile(r"[@\s\[({]"), regex.compile(r"[._+\-\d]+")
LAST_GROUP = regex.compile(rf"{GAP}(\d+)$")
FOLLOWED = regex.compile(rf"{GAP}[^\W\d_]{{3,}}")
FILE_END = regex.compile(r"\.(?:png|jpe?g|gif|svg|webp|ico|js|css|txt|pdf|html?|xml|json|csv|md)$", regex.IGNORECASE)  # names of files, no domains
MIXED_DIGIT, MIXED_LETTER = regex.compile(r"\d"), regex.compile(r"[^\W\d_]")


def tokenize(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, type). A number's last group stands apart where a word follows: it may begin another sentence.
    Runs of at most four capitals are of a type of their own, since numbers of papers have such parts."""
    out = []
    for m in (TOKEN if ADDRESS.search(text) else PLAIN).finditer(text):
        begin, end = m.span()
        kind = m.lastgroup
        if kind == "w":
            kind = "caps" if end - begin <= 4 and text[begin:end].isupper() else "word"
        elif kind == "number":
            if (last := LAST_GROUP.search(text, begin, end)) and FOLLOWED.match(text, end):
                out.append((begin, last.start(), kind))
                begin, kind = last.start(1), "tail"
        elif kind == "word" and end - begin <= 4 and text[begin:end].isupper():
            kind = "caps"
        elif kind == "mail" and FILE_END.search(text, begin, end):
            kind = "url"
        elif kind == "mixed":
            whole = text[begin:end]  # the looks ahead may have met a digit or a letter behind the run
            if not MIXED_DIGIT.search(whole):
                kind = "word"
            elif not MIXED_LETTER.search(whole):
                kind = "number"
        out.append((begin, end, kind))
    return out


def shape(word: str) -> str:
    """Letter classes with runs shortened: Xx, X, x, X-Xx; digits are counted."""
    out: list[str] = []
    for c in word[:24]:
        s = "X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else "_" if c.isspace() else c
        if s == "0" or not (len(out) > 1 and out[-1] == s == out[-2]):
            out.append(s)
    return "".join(out)


def form(word: str) -> str:
    """Every letter and digit by its class only: A0 A00 and the like."""
    return "".join("X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else "_" if c.isspace() else c for c in word[:32])


U = np.uint64
BITS = 19
ROWS = 1 << BITS
#: What a token's features are made of: word, shape, type, endings of 2 to 4 letters, beginning of 3, script, digits, form of a mail address in three parts.
PARTS = ("w", "s", "k", "e2", "e3", "e4", "a3", "script", "digits", "m1", "m2", "m3")
W, S, K, D = 0, 1, 2, 8


def _number(name: str, value: object) -> int:
    return xxhash.xxh3_64_intdigest(f"{name}={value}")


@lru_cache(maxsize=1 << 17)
def outline(token: str, kind: str) -> tuple[int, ...]:
    """Hashes of PARTS; 0 where a part says nothing. Numbers and mixed runs show their form and how they begin, mail
    addresses and links not even that."""
    low = token.lower()
    digits = min(16, sum(c.isdigit() for c in token))
    if kind in ("number", "tail", "mixed"):
        w, head, ends = form(token), lead(token), f"{token[0].isalpha():d}{token[-1].isalpha():d}{len(token)}" if kind == "mixed" else None
        values = (w, f"#{kind}{digits}{shape(token) if kind == 'mixed' else ''}", kind, f"{head}/{digits}", ends, None, head, None, f"{kind}{digits}", None, None, None)
    elif kind == "mail":
        values = (kind, kind, kind, None, None, None, None, None, None, "@" in token, regex.search("@[0-9]", token) is not None, token.count(" "))
    elif kind == "url":
        values = (kind,) * 3 + (None,) * 9
    else:
        word = kind in ("word", "caps")
        closed = word_class(low) if word else ""
        letters = (low[-2:], low[-3:], low[-4:], low[:3], script(low[0])) if word and closed != "f" else (None,) * 5  # endings of closed classes say nothing
        values = (low, shape(token) + closed, kind, *letters, None, None, None, None)
    return tuple(0 if v is None else _number(n, v) for n, v in zip(PARTS, values))


def lead(number: str) -> str:
    """How a number begins: calls abroad have a plus or two zeros, calls within a country one; three zeros reach nobody."""
    digits = "".join(c for c in number if c.isdigit())
    return "+" if "+" in number[:2] else str(min(3, len(digits) - len(digits.lstrip("0"))))


def script(c: str) -> str:
    return "latin" if c < "ɐ" else "cyrillic" if "Ѐ" <= c <= "ӿ" else "other"


EDGE = tuple(_number("edge", n) if n in ("w", "s", "k") else 0 for n in PARTS)
#: Joined features: (part, place) of two or three tokens.
JOINED = (
    ((S, -1), (S, 0)), ((S, 0), (S, 1)), ((S, -1), (S, 0), (S, 1)), ((S, -2), (S, -1), (S, 0)), ((S, 0), (S, 1), (S, 2)), ((W, -1), (S, 0)), ((S, 0), (W, 1)), ((W, -2), (W, -1)), ((W, 1), (W, 2)),
    ((W, -1), (W, 1)), ((W, -1), (W, 0)), ((W, 0), (W, 1)), ((W, -2), (W, -1), (S, 0)), ((D, 0), (W, -1)), ((D, 0), (W, -2)), ((K, -1), (K, 0), (K, 1)), ((S, -2), (W, -1), (S, 0)), ((K, -2), (K, -1), (K, 0), (K, 1), (K, 2)),
)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + U(salt * 0x9E3779B97F4A7C15 % 2**64)) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(32))


def describe(text: str, tokens: list[tuple[int, int, str]]) -> tuple[list[tuple[int, ...]], list[int]]:
    """The outline of each token and the kind of gap around it."""
    gaps, before = [], 0
    for begin, end, _ in tokens:
        between = text[before:begin]
        gaps.append((0 if not between else 2 if "\n" in between else 1) * 2 + (text[end:end + 1] == "\n"))
        before = end
    if gaps:
        gaps[0] = 4 + gaps[0] % 2
    return [outline(text[b:e], k) for b, e, k in tokens], gaps


def features(outlines: list[tuple[int, ...]], gaps: list[int] | np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(tokens, columns) feature numbers of concatenated texts; ROWS where a column says nothing."""
    n = len(outlines)
    base = np.array(outlines, U).reshape(n, len(PARTS))
    text = np.repeat(np.arange(len(lengths)), lengths)
    moved = {0: base}
    for step in (-2, -1, 1, 2):
        at = np.arange(n) + step
        inside = (at >= 0) & (at < n)
        inside[inside] = text[at[inside]] == text[inside]
        moved[step] = np.where(inside[:, None], base[np.clip(at, 0, max(0, n - 1))], np.array(EDGE, U))
    gap = np.array(gaps, U)
    columns: list[np.ndarray] = [base[:, i] for i in range(len(PARTS))]  # 0 to 11
    columns += [moved[step][:, W] for step in (-2, -1, 1, 2)]  # 12 to 15
    columns += [_mixed(gap, 90) ^ moved[-1][:, K] ^ base[:, K] * U(3), _mixed(gap, 91), _mixed(gap, 92) ^ base[:, S]]  # 16 to 18
    silent = [c == 0 for c in columns]
    for number, joined in enumerate(JOINED):
        value = np.zeros(n, U)
        for part, place in joined:
            value = _mixed(value ^ moved[place][:, part], 300 + number)
        columns.append(value)
        silent.append(base[:, D] == 0 if joined[0] == (D, 0) else np.zeros(n, bool))
    out = np.empty((n, len(columns)), np.int32)
    for i, (value, none) in enumerate(zip(columns, silent)):
        out[:, i] = np.where(none, ROWS, (_mixed(value, i + 1) >> U(64 - BITS)).astype(np.int64))
    return out


def skip_edges(text: str, tokens: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Pairs of tokens that are equal, or alike as a name and the address made of it.

    A token is joined with the next one that shares its word (of four letters or more) or, for a mail address, a part of
    its local name; chains of such pairs connect all, so their number grows with the text and not its square.
    """
    out, last = set(), {}
    for i, (begin, end, kind) in enumerate(tokens):
        if kind == "word" and end - begin >= 4:
            low = text[begin:end].lower()
            keys = [low] if text[begin].isupper() or low in last else []
        elif kind == "mail":
            local = LOCAL_END.split(text[begin:end].lower(), maxsplit=1)[0]
            keys = sorted({p for p in LOCAL_CUT.split(local) if len(p) >= 4})
        else:
            continue
        for key in keys:
            if key in last and last[key] != i and i - last[key] > 1:
                out.add((last[key], i))
            last[key] = i
    return sorted(out)


#: Labels that a token of each type may bear beside O. A word can only be part of a name or an address; which of them, and what a number or a mixed run is, the field decides.
FITS = {
    "mail": {"B-email"}, "url": set(), "mark": {"I-name", "I-address", "I-id_number", "I-phone"},
    "number": {"B-phone", "I-phone", "B-id_number", "I-id_number", "B-address", "I-address"}, "tail": {"B-phone", "I-phone", "B-id_number", "I-id_number", "B-address", "I-address"},
    "mixed": {"B-id_number", "I-id_number", "B-address", "I-address"}, "caps": {"B-name", "I-name", "B-address", "I-address", "B-id_number", "I-id_number"},
    "word": {"B-name", "I-name", "B-address", "I-address"},
}
ORDER = {kind: i for i, kind in enumerate(FITS)}
LIMITS = np.array([[0.0 if x == "O" or x in fits else crf.FORBIDDEN for x in LABELS] for fits in FITS.values()])


WITHIN_A_LINE = np.array([crf.FORBIDDEN if x.startswith("I-") else 0.0 for x in LABELS])


def limits_of(kinds: list[str], gaps: np.ndarray) -> np.ndarray:
    """Scores that keep labels off the tokens that can't bear them; no value goes on in the next line."""
    return LIMITS[[ORDER[kind] for kind in kinds]] + (gaps >= 4)[:, None] * WITHIN_A_LINE


MODELS: dict[tuple[int, int, int], crf.Model] = {}


def trained(size: int = 12000, seed: int = 11, parts: int = 6, spark: SparkSession | None = None) -> crf.Model:
    """The model; the same for the same numbers. It is the mean of `parts` fits, each on `size` generated texts of its
    own, since what a single fit makes of words that it doesn't know is swayed by chance. With a session the fits run side
    by side as tasks of the cluster."""
    key = (size, seed, parts)
    if key not in MODELS:
        fit = lambda part: crf.pack(fitted(size, seed + part))
        packed = spark.sparkContext.parallelize(range(parts), parts).map(fit).collect() if spark else [fit(part) for part in range(parts)]
        MODELS[key] = crf.mean_of(packed, LABELS, ROWS)
    return MODELS[key]


def fitted(size: int, seed: int) -> crf.Model:
    """One fit on `size` generated texts."""
    told, golds, edges = [], [], []
    number = {x: i for i, x in enumerate(LABELS)}
    for text, spans in training_texts(size, seed):
        tokens = tokenize(text)
        if not tokens:
            continue
        gold = ["O"] * len(tokens)
        for begin, end, kind in spans:
            inside = [i for i, (b, e, _) in enumerate(tokens) if b < end and e > begin]
            if inside and tokens[inside[0]][0] == begin and tokens[inside[-1]][1] == end:
                for n, i in enumerate(inside):
                    gold[i] = ("I-" if n else "B-") + kind
        if any(g != "O" and g not in FITS[k] for g, (_, _, k) in zip(gold, tokens)):
            continue
        told.append(describe(text, tokens))
        golds.append(np.array([number[g] for g in gold]))
        edges.append(skip_edges(text, tokens))
    texts: list[np.ndarray] = []
    for at in range(0, len(told), 256):
        some = told[at:at + 256]
        lengths = np.array([len(gaps) for _, gaps in some])
        all_features = features([o for outlines, _ in some for o in outlines], np.concatenate([gaps for _, gaps in some]), lengths)
        texts += np.split(all_features, np.cumsum(lengths)[:-1])
    model = crf.fit(texts, golds, LABELS, ROWS, epochs=5)
    crf.fit_skip(model, edges, golds)
    return model


LEAN = 0.4
NEAR = -6.0


def find_all(model: crf.Model, texts: list[str | None], most_tokens: int = 60_000, lean: float = LEAN) -> list[list[tuple[int, int, str]]]:
    """(begin, end, kind) of the values in each text, in order. Texts are labelled whole, together in groups of like
    length, so time and memory follow the number of tokens. `lean` is taken off the score of no label: a value left in
    the text does more harm than a placeholder too many.

    What can be told from scores alone costs no messages: skip edges between tokens that are both far from any label
    are left out, and texts of nothing but such tokens have no values.
    """
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    cut = [(i, t) for i, text in enumerate(texts) if text for t in [tokenize(text)] if t]
    group: list[tuple[int, list]] = []

    def scored(group: list[tuple[int, list]]) -> list[tuple[int, list, np.ndarray, np.ndarray]]:
        lengths = np.array([len(tokens) for _, tokens in group])
        told = [describe(texts[i], tokens) for i, tokens in group]
        gaps = np.concatenate([g for _, g in told])
        scores = model.scores(features([o for outlines, _ in told for o in outlines], gaps, lengths))
        scores[:, 0] -= lean
        scores += limits_of([k for _, tokens in group for _, _, k in tokens], gaps)
        near = scores[:, 1:].max(axis=1) - scores[:, 0] > NEAR
        at = np.cumsum(lengths) - lengths
        some = np.add.reduceat(near, at) > 0
        return [(i, tokens, scores[a:a + len(tokens)], near[a:a + len(tokens)]) for (i, tokens), a, s in zip(group, at.tolist(), some.tolist()) if s]

    kept, held = [], 0
    for i, tokens in cut:
        if held + len(tokens) > most_tokens and group:
            kept += scored(group)
            group, held = [], 0
        group.append((i, tokens))
        held += len(tokens)
    kept += scored(group) if group else []
    kept.sort(key=lambda x: len(x[1]))
    begin = 0
    while begin < len(kept):
        end, held = begin, 0
        while end < len(kept) and (end == begin or (held + len(kept[end][1]) <= most_tokens and len(kept[end][1]) <= 1.5 * len(kept[begin][1]) + 8)):
            held += len(kept[end][1])
            end += 1
        part = kept[begin:end]
        edges = [[e for e in skip_edges(texts[i], tokens) if near[e[0]] or near[e[1]]] for i, tokens, _, near in part]
        lengths = np.array([len(tokens) for _, tokens, _, _ in part])
        found = crf.label(model, np.concatenate([s for _, _, s, _ in part]), lengths, edges).tolist()
        at = 0
        for i, tokens, _, _ in part:
            out[i] = spans_of(tokens, found[at:at + len(tokens)])
            at += len(tokens)
        begin = end
    return out


def spans_of(tokens: list[tuple[int, int, str]], labels: list[int]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for t, x in enumerate(labels):
        if x:
            begin, end, _ = tokens[t]
            label = LABELS[x]
            if label[0] == "B":
                out.append((begin, end, label[2:]))
            else:
                out[-1] = (out[-1][0], end, out[-1][2])
    return out


def find_personal(documents: DataFrame, size: int = 12000) -> DataFrame:
    """(doc_id, kind, found_text): the distinct personal values in `documents(doc_id, text)`, one row each.

    kind is one of KINDS; found_text is as in the text. A null or blank text gives no row; repeated rows of documents
    give repeated values. Other columns are not read. The model is fitted on generated texts, `size` for each of its
    parts, and sent to the workers; texts are labelled in one pass without a shuffle.
    """
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(trained(size, spark=spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 4096):
                piece = batch.slice(part, 4096)
                texts = piece.column("text").to_pylist()
                rows = [(i, kind, value) for i, spans in enumerate(find_all(model.value, texts)) for kind, value in dict.fromkeys((k, texts[i][b:e]) for b, e, k in spans)]
                at = pa.array([r[0] for r in rows], pa.int32())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(at), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["doc_id", "kind", "found_text"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, kind string, found_text string")


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [NAME] in place of the values."""
    if not spans:
        return text
    out, at = [], 0
    for begin, end, kind in spans:
        out += [text[at:begin], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def redact_personal(documents: DataFrame, size: int = 12000) -> DataFrame:
    """(doc_id, redacted, values) for every row of `documents(doc_id, text)`: the text with typed placeholders and the
    number of replaced values. All else in the text stays; a null text stays null."""
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(trained(size, spark=spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 4096):
                piece = batch.slice(part, 4096)
                texts = piece.column("text").to_pylist()
                found = find_all(model.value, texts)
                yield pa.RecordBatch.from_arrays([
                    piece.column("doc_id"), pa.array([redact(t, s) for t, s in zip(texts, found)], pa.string()), pa.array([len(s) for s in found], pa.int64()),
                ], names=["doc_id", "redacted", "values"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, redacted string, values bigint")
