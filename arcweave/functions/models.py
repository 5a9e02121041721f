"""Recognisers and classifiers as pluggable backends of iterator UDFs.

A backend is loaded once a Python worker, never on the driver. The rule backends
need no model and are deterministic; a model library is used if it is installed.
"""

from __future__ import annotations

import functools
import importlib.util
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweave.functions.entities import TOP_LABELS
from arcweave.functions.text import MIN_SENTENCE, rule_sentences

MENTIONS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.StringType())]))
SCORES = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("confidence", T.FloatType())]))
SCORED = T.StructType([T.StructField("scores", SCORES), T.StructField("error", T.StringType())])
# What image networks of this kind are trained on.
RESIZED, CROPPED = 256, 224
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
_NAME = re.compile(r"(?:[A-Z][\w'-]+)(?:\s+(?:of|and|for|the|de)?\s*[A-Z][\w'-]+)+")


def rule_recognizer() -> Callable[[str], list[tuple[str, str]]]:
    """Runs of capitalised words; the label is ORG if a word for a body occurs in it, else PERSON."""
    body = re.compile(r"Institut|Universit|Department|Council|Societ|Compan|Corporation|Office|Association|College|Laborator|Foundation|Group|Limited")
    return lambda s: [(m.group(), "ORG" if body.search(m.group()) else "PERSON") for m in _NAME.finditer(s)]


def spacy_recognizer(model: str = "en_core_web_md") -> Callable[[str], list[tuple[str, str]]]:
    import spacy

    nlp = spacy.load(model)
    return lambda s: [(e.text, e.label_) for e in nlp(s).ents]


def spacy_sentences(model: str = "en_core_web_md") -> Callable[[str], list[str]]:
    import spacy

    nlp = spacy.load(model)
    return lambda text: [s.text for s in nlp(text).sents]


def installed(model: str) -> bool:
    """Whether a spaCy model of this name can be loaded here."""
    return bool(model) and all(importlib.util.find_spec(name) for name in ("spacy", model))


def recognizer(model: str) -> Callable[[], Callable]:
    """The recogniser that a configuration names: its model if it is installed, else the rules."""
    return functools.partial(spacy_recognizer, model) if installed(model) else rule_recognizer


def split_sentences(text: Column, model: str) -> Column:
    """Sentences of at least ``MIN_SENTENCE`` characters, by the model if it is installed, else by rules; null gives null."""
    if not installed(model):
        return rule_sentences(text)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        split = spacy_sentences(model)
        for batch in batches:
            yield batch.map(lambda t: None if t is None else [x for x in map(str.strip, split(t)) if len(x) >= MIN_SENTENCE])

    return run(text)


def recognize(sentences: Column, backend: Callable[[], Callable] = rule_recognizer) -> Column:
    """Mentions ``(text, label)`` of an array of sentences; null gives an empty array."""

    @F.pandas_udf(MENTIONS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = backend()
        for batch in batches:
            yield batch.map(lambda ss: [{"text": t, "label": l} for s in (ss if ss is not None else ()) for t, l in find(s)])

    return run(sentences)


def resized(pixels: np.ndarray, short: int) -> np.ndarray:
    """Height x width x 3 pixels scaled so that the shorter side has ``short`` pixels, by linear interpolation."""
    h, w = pixels.shape[:2]
    scale = short / min(h, w)

    def along(x: np.ndarray, n: int) -> np.ndarray:
        at = np.clip((np.arange(n) + 0.5) * len(x) / n - 0.5, 0, len(x) - 1)
        low = np.floor(at).astype(int)
        part = (at - low)[:, None, None]
        return x[low] * (1 - part) + x[np.minimum(low + 1, len(x) - 1)] * part

    tall = along(pixels.astype(np.float64), max(short, round(h * scale)))
    return along(tall.swapaxes(0, 1), max(short, round(w * scale))).swapaxes(0, 1)


def image_input(pixels: np.ndarray) -> np.ndarray:
    """1 x 3 x CROPPED x CROPPED input of a network: resized, cropped at the centre, scaled to 0..1 and normalised."""
    x = resized(pixels, RESIZED) / 255
    top, left = ((n - CROPPED) // 2 for n in x.shape[:2])
    x = (x[top : top + CROPPED, left : left + CROPPED] - np.array(MEAN)) / np.array(DEVIATION)
    return x.transpose(2, 0, 1)[None].astype(np.float32)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def network_classifier(run: Callable[[np.ndarray], np.ndarray], labels: Sequence[str], decode: Callable[[bytes], np.ndarray], top: int = TOP_LABELS) -> Callable[[bytes], list[tuple[str, float]]]:
    """The ``top`` labels of an image by a network's softmax, best first, ties by place."""

    def score(raw: bytes) -> list[tuple[str, float]]:
        p = softmax(np.asarray(run(image_input(decode(raw))), np.float64).reshape(-1))
        return [(labels[k], float(p[k])) for k in np.argsort(-p, kind="stable")[:top]]

    return score


def onnx_classifier(path: str, labels: Sequence[str]) -> Callable[[bytes], list[tuple[str, float]]]:
    """An ONNX network with onnxruntime; images are decoded by Pillow. Both are loaded in the worker."""
    import io

    import onnxruntime
    from PIL import Image

    session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
    name = session.get_inputs()[0].name
    return network_classifier(lambda x: session.run(None, {name: x})[0], labels, lambda raw: np.asarray(Image.open(io.BytesIO(raw)).convert("RGB")))


def classify(content: Column, backend: Callable[[], Callable]) -> Column:
    """``(scores, error)`` of image bytes: scores ``(label, confidence)``; an image that fails has none and a message, others go on."""

    @F.pandas_udf(SCORED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = backend()

        def one(raw):
            try:
                return [{"label": l, "confidence": float(c)} for l, c in score(bytes(raw))], None
            except Exception as e:  # noqa: BLE001  one bad image must not stop the rest
                return [], f"{type(e).__name__}: {e}"

        for batch in batches:
            found = [one(raw) for raw in batch]
            yield pd.DataFrame({"scores": pd.Series([f[0] for f in found], dtype=object), "error": pd.Series([f[1] for f in found], dtype=object)})

    return run(content)
