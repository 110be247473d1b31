"""Second-stage encoders: tokenizers, windows over long texts, and ONNX scoring in Arrow batches.

Model files aren't part of this package; a folder with a contract (JSON), vocabulary and model is a
parameter. Without them, or without the runtime, scoring gives a null score and an error, never a guess.
"""

from __future__ import annotations

import contextlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Characters of a window, the step between windows, and the length from which a middle window is scored.
WINDOW, STRIDE, MIDDLE_FROM = 500, 250, 1500
# Special ids of the byte-pair vocabulary.
BPE_PAD, BPE_UNKNOWN, BPE_START = 0, 1, 2
# A word of more characters is unknown as a whole.
LONGEST_WORD = 100
# Ranges of ideographs that are words of their own.
IDEOGRAPHS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))

_IDEOGRAPH = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in IDEOGRAPHS) + "])")
_DROPPED = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ufffd]")
_SPACES = re.compile("[\t\n\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")
_ACCENT = re.compile("[\u0300-\u036f]")


class EncoderUnavailable(RuntimeError):
    """The runtime or a model file is missing."""


@lru_cache(maxsize=8192)
def _is_mark(c: str) -> bool:
    """ASCII signs, and whatever Unicode counts as punctuation or symbol."""
    return unicodedata.category(c)[0] in "PS"


def basic_tokens(text: str, lower: bool) -> list[str]:
    """Words, with control characters dropped and every sign and ideograph on its own."""
    out = []
    spaced = _IDEOGRAPH.sub(r" \1 ", _DROPPED.sub("", text))
    for word in _SPACES.split(spaced):
        if lower:
            word = _ACCENT.sub("", unicodedata.normalize("NFD", word.lower()))
        begin = 0
        for i, c in enumerate(word):
            if _is_mark(c):
                out += [word[begin:i], c] if i > begin else [c]
                begin = i + 1
        if begin < len(word):
            out.append(word[begin:])
    return out


@dataclass(frozen=True)
class Contract:
    """What a model folder's JSON says."""

    version: str
    max_len: int
    model_file: str
    inputs: tuple[str, ...] = ("input_ids", "attention_mask")
    output: str = "logits"
    do_lower_case: bool = False
    cls_id: int = 2
    sep_id: int = 3
    pad_id: int = 0
    unk_id: int = 1
    injection_logit_index: int = 1
    prefix_token_ids: tuple[int, ...] = ()

    @staticmethod
    def load(path: str | Path) -> Contract:
        if not Path(path).exists():
            raise EncoderUnavailable(f"no contract at {path}")
        given = json.loads(Path(path).read_text())
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in Contract.__dataclass_fields__}
        return Contract(**known)


def read_vocabulary(spark: SparkSession, path: str) -> dict[str, int]:
    """A vocabulary's line numbers by token, from any store that Spark reads; its size is that of a model's vocabulary."""
    text = spark.read.text(path, wholetext=True).first()
    return {token: i for i, token in enumerate((text[0] if text else "").split("\n"))}


class WordPiece:
    """Greedy longest pieces from a vocabulary; pieces inside a word are marked by ##."""

    def __init__(self, vocabulary: dict[str, int], contract: Contract):
        self.vocabulary, self.contract = vocabulary, contract
        self.longest = max((len(t) for t in vocabulary), default=1)

    def pieces(self, word: str) -> list[int]:
        if len(word.encode("utf-16-le")) // 2 > LONGEST_WORD:
            return [self.contract.unk_id]
        ids, at = [], 0
        while at < len(word):
            mark = "##" if at else ""
            for end in range(min(len(word), at + self.longest), at, -1):
                piece = self.vocabulary.get(mark + word[at:end])
                if piece is not None:
                    ids.append(piece)
                    at = end
                    break
            else:
                return [self.contract.unk_id]
        return ids

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids and mask, max_len of each."""
        c = self.contract
        room = c.max_len - 2 - len(c.prefix_token_ids)
        body: list[int] = []
        for word in basic_tokens(text, c.do_lower_case):
            body += self.pieces(word)
            if len(body) >= room:
                break
        ids = [c.cls_id, *c.prefix_token_ids, *body[:room], c.sep_id]
        pad = c.max_len - len(ids)
        return ids + [c.pad_id] * pad, [1] * len(ids) + [0] * pad


@dataclass
class BytePairs:
    """Byte-pair encoding: a symbol is its bytes' numbers, comma-joined; merges in order of rank."""

    ids: dict[str, int]
    merges: list[tuple[str, str]]
    ranks: dict[tuple[str, str], int] = field(init=False)

    def __post_init__(self) -> None:
        self.ranks = {tuple(pair): i for i, pair in enumerate(self.merges)}

    @staticmethod
    def load(path: str | Path) -> BytePairs:
        blob = json.loads(Path(path).read_text())
        return BytePairs(blob["tok2id"], [tuple(m) for m in blob["merges"]])

    def merged(self, chunk: str) -> list[int]:
        symbols = [str(b) for b in chunk.encode()]
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(pair, len(self.ranks)), i) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == len(self.ranks):
                break
            symbols[at : at + 2] = [f"{symbols[at]},{symbols[at + 1]}"]
        return [self.ids.get(s, BPE_UNKNOWN) for s in symbols]

    def encode(self, text: str, max_len: int) -> tuple[list[int], list[int]]:
        ids = [BPE_START]
        for chunk in re.split(f"({_SPACES.pattern})", text):
            ids += self.merged(chunk) if chunk else []
            if len(ids) >= max_len:
                break
        ids = ids[:max_len]
        pad = max_len - len(ids)
        return ids + [BPE_PAD] * pad, [1] * len(ids) + [0] * pad


ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("mask", T.ArrayType(T.IntegerType()))])


def encoded(text: Column, encode: Callable[[str], tuple[list[int], list[int]]]) -> Column:
    """struct<ids, mask> of each text, in Arrow batches; null for null."""

    @pandas_udf(ENCODED)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([encode(t) if t is not None else (None, None) for t in texts], columns=["ids", "mask"])

    return F.when(text.isNotNull(), run(text))


def tokens(text: Column, lower: bool = False) -> Column:
    """array<string> of basic tokens."""

    @pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else basic_tokens(t, lower))

    return run(text)


def anchored_windows(text: Column) -> Column:
    """The text if it fits a window; else its head and tail, and the middle of very long ones."""
    n = F.length(text)
    ends = F.array(F.substring(text, 1, WINDOW), F.substring(text, -WINDOW, WINDOW))
    middle = F.substr(text, (F.floor(n / 2) - WINDOW // 2 + 1).cast("int"), F.lit(WINDOW))
    return F.when(n <= WINDOW, F.array(text)).when(n > MIDDLE_FROM, F.concat(ends, F.array(middle))).when(n > WINDOW, ends)


def sliding_windows(text: Column, full_tail: bool = False) -> Column:
    """The text if it fits a window; else whole windows with half a window's overlap. A last part that no whole
    window reaches is left out, as the encoders were measured; full_tail adds it."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0)), F.lit(STRIDE))
    windows = F.transform(starts, lambda s: F.substr(text, s + 1, F.lit(WINDOW)))
    if full_tail:
        windows = F.when((n - WINDOW) % STRIDE != 0, F.concat(windows, F.array(F.substring(text, -WINDOW, WINDOW)))).otherwise(windows)
    return F.when(n <= WINDOW, F.array(text)).when(n > WINDOW, windows)


def whole_text(text: Column) -> Column:
    return F.when(text.isNotNull(), F.array(text))


#: Encoders by kind: the contract's file and how long texts are cut.
KINDS = {"l5b": ("l5b.json", whole_text), "l5c": ("l5c.json", whole_text), "l5d": ("l5d.json", anchored_windows), "l5e": ("l5e.json", sliding_windows)}
_sessions: dict[str, object] = {}

SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("error", T.StringType())])


def _located(folder: str, name: str) -> Path:
    """A model's file: in the folder, if workers see it, else as SparkContext.addFile(folder, recursive=True) spread it."""
    direct = Path(folder, name)
    if not direct.exists():
        from pyspark import SparkFiles

        with contextlib.suppress(Exception):  # a worker that was sent no files has no place for them
            sent = Path(SparkFiles.get(Path(folder).name), name)
            if sent.exists():
                return sent
    return direct


def _session(path: str):
    """One per worker and model."""
    if path not in _sessions:
        if not Path(path).exists():
            raise EncoderUnavailable(f"no model at {path}")
        try:
            import onnxruntime
        except ImportError as e:
            raise EncoderUnavailable("onnxruntime isn't installed") from e
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        _sessions[path] = onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])
    return _sessions[path]


def encoder_scorer(kind: str, folder: str, batch: int = 64, most_chars: int | None = None) -> Callable[[Column], Column]:
    """text -> struct<score, error>: the largest probability of an injection over the text's windows. Windows of an Arrow
    batch go through the model together, batch at a time; texts are cut to most_chars before, if given. folder is a path
    that workers see, or the name of one that addFile spread."""
    name, cut = KINDS[kind]

    @pandas_udf(SCORED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import numpy as np

        problem, contract, encode = None, None, None
        try:
            contract = Contract.load(_located(folder, name))
            session = _session(str(_located(folder, contract.model_file)))
            if kind == "l5c":
                pairs = BytePairs.load(_located(folder, "tokenizer.json"))
                encode = lambda t: pairs.encode(t, contract.max_len)
            else:
                lines = _located(folder, "vocab.txt").read_text().split("\n")
                encode = WordPiece({t: i for i, t in enumerate(lines)}, contract).encode
        except (EncoderUnavailable, OSError, KeyError, TypeError, ValueError) as e:
            problem = f"{type(e).__name__}: {e}"
        for windows in batches:
            if problem:
                yield pd.DataFrame({"score": pd.Series([None] * len(windows), dtype=object), "error": [problem if w is not None else None for w in windows]})
                continue
            flat = [(i, w) for i, ws in enumerate(windows) if ws is not None for w in ws]
            scores = np.full(len(windows), np.nan)
            for at in range(0, len(flat), batch):
                some = flat[at : at + batch]
                ids, mask = (np.array(x, np.int64) for x in zip(*(encode(w) for _, w in some), strict=True))
                feeds = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
                logits = session.run([contract.output], {k: feeds[k] for k in contract.inputs})[0].astype(float)
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p = (p / p.sum(axis=1, keepdims=True))[:, contract.injection_logit_index]
                np.fmax.at(scores, [i for i, _ in some], p)
            yield pd.DataFrame({"score": pd.Series([None if np.isnan(s) else float(s) for s in scores], dtype=object), "error": [None] * len(scores)})

    return lambda text: run(cut(text if most_chars is None else F.substring(text, 1, most_chars)))
