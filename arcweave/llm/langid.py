"""Language of documents and of the stretches within them: a byte convolutional network.

The network is trained in numpy on a bounded sample of labelled documents and
applied to every fixed-length window of every document. Windows vote within
sentences, sentences are joined into stretches by a cheapest path.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from arcweave.llm.sentences import outside_lines, units
from arcweave.session import shared_dir

if TYPE_CHECKING:
    from collections.abc import Callable, Iterator

    from pyspark.sql import DataFrame

WINDOW, DEPTH, STRIDE = 96, 8, 2
WIDTHS = {4: 24, 7: 56}   # filters by width in bytes
WIDEST = max(WIDTHS)
SAMPLE = 300              # labelled documents a language that the network is fitted on, at most
STEPS = 58, 100           # of the first and the second fit, for each language
LEAST_LANGUAGES = 8       # the steps are those of so many languages at least
HELD_OUT = 8              # one document in so many is kept from the first fit, whose margins on it calibrate confidence
SWITCH = 2.0              # nats a change of language costs
SURE = 2.0                # nats by which a sentence must speak for its language
_SPACELESS = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]")
_LETTERS = re.compile(r"(?:[^\W\d_][\W\d_]*){4}")
# ISO 639-1 code, three-letter codes and English name.
_NAMES = """af afr Afrikaans;ar ara Arabic;bg bul Bulgarian;bn ben Bengali;ca cat Catalan;cs ces cze Czech;da dan Danish;
de deu ger German;el ell gre Greek;en eng English;es spa Spanish;et est Estonian;eu eus baq Basque;fa fas per Persian;
fi fin Finnish;fr fra fre French;ga gle Irish;gl glg Galician;gu guj Gujarati;he heb Hebrew;hi hin Hindi;hr hrv Croatian;
hu hun Hungarian;hy hye arm Armenian;id ind Indonesian;is isl ice Icelandic;it ita Italian;ja jpn Japanese;ka kat geo Georgian;
kk kaz Kazakh;kn kan Kannada;ko kor Korean;lt lit Lithuanian;lv lav Latvian;mk mkd mac Macedonian;ml mal Malayalam;
mn mon Mongolian;mr mar Marathi;ms msa may Malay;nb nob Bokmal;ne nep Nepali;nl nld dut Dutch;no nor Norwegian;pa pan Punjabi;
pl pol Polish;pt por Portuguese;ro ron rum Romanian;ru rus Russian;sk slk slo Slovak;sl slv Slovenian;sq sqi alb Albanian;
sr srp Serbian;sv swe Swedish;sw swa Swahili;ta tam Tamil;te tel Telugu;th tha Thai;tl tgl Tagalog;tr tur Turkish;
uk ukr Ukrainian;ur urd Urdu;uz uzb Uzbek;vi vie Vietnamese;zh zho chi Chinese"""
NAMES = {name.lower(): row.split()[0] for row in _NAMES.split(";") for name in row.split()}
def label_code(label: str | None) -> str | None:
    """ISO 639-1 code that a label states, or None."""
    return NAMES.get(re.split(r"[-_]", (label or "").strip().lower())[0])


def label_column(c):
    """``label_code`` as a column expression."""
    base = F.lower(F.split(F.trim(c), "[-_]")[0])
    return F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])[F.coalesce(base, F.lit(""))]


def sentences(text: str) -> list[tuple[int, int]]:
    """Begin and end of the sentence units that have at least four letters."""
    return [(a, b) for a, b in units(text) if _LETTERS.search(text, a, b)]


_CAPITAL = re.compile(r"(?<![^\s(“„«‘\"'])[A-Z][a-z]{3,}")
_ACCENTS = str.maketrans("aeioun", "áéíöüñ")


def accented(piece: str, rng: np.random.Generator) -> str:
    """The piece with one letter of one capitalised word accented: names say nothing of the language around them."""
    found = list(_CAPITAL.finditer(piece))
    if not found:
        return piece
    m = found[rng.integers(len(found))]
    at = int(rng.integers(m.start() + 1, m.end()))
    return piece[:at] + piece[at].translate(_ACCENTS) + piece[at + 1 :]


def windows(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Byte windows of all pieces, each padded with zeros, and the number of windows of each."""
    raw = [p.lower().encode() for p in pieces]
    n = np.array([-(-len(r) // WINDOW) for r in raw], np.int64)
    data = b"".join([r.ljust(k * WINDOW, b"\0") for r, k in zip(raw, n.tolist())])
    return np.frombuffer(data, np.uint8).reshape(-1, WINDOW), n


class Network:
    """Byte embedding, filters of several widths, max pooling, softmax."""

    def __init__(self, classes: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        filters = sum(WIDTHS.values())
        self.mask = np.concatenate([np.repeat([[k < w] for k in range(WIDEST) for _ in range(DEPTH)], f, 1) for w, f in WIDTHS.items()], 1).astype(np.float32)
        self.weights = [
            rng.normal(0, 0.5, (256, DEPTH)), rng.normal(0, 0.15, (WIDEST * DEPTH, filters)) * self.mask, np.zeros(filters),
            rng.normal(0, 0.2, (filters, classes)), np.zeros(classes),
        ]
        self.weights = [w.astype(np.float32) for w in self.weights]

    def columns(self, win: np.ndarray) -> np.ndarray:
        x = self.weights[0][win]
        n, s = len(x), x.strides
        steps = (WINDOW - WIDEST) // STRIDE + 1
        view = np.lib.stride_tricks.as_strided(x, (n, steps, WIDEST * DEPTH), (s[0], STRIDE * s[1], s[2]))
        return np.ascontiguousarray(view).reshape(n * steps, -1)

    def log_probs(self, win: np.ndarray) -> np.ndarray:
        _, w, b, v, c = self.weights
        out = []
        for k in range(0, len(win), 128):
            part = win[k : k + 128]
            act = (self.columns(part) @ w).reshape(len(part), -1, w.shape[1]).max(1) + b
            logits = np.maximum(act, 0) @ v + c
            logits -= logits.max(1, keepdims=True)
            out.append(logits - np.log(np.exp(logits).sum(1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(c)), np.float32)

    def fit(self, win: np.ndarray, label: np.ndarray, steps: int, seed: int, rate: float = 4e-3, batch: int = 256) -> None:
        rng = np.random.default_rng(seed)
        first, second, t = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        a_pass = max(1, -(-len(win) // batch))
        epochs = -(-steps // a_pass)
        rounds = epochs * a_pass
        for _ in range(epochs):
            order = rng.permutation(len(win))
            for k in range(0, len(order), batch):
                x, y = win[order[k : k + batch]], label[order[k : k + batch]]
                e, w, b, v, c = self.weights
                col = self.columns(x)
                act = (col @ w).reshape(len(x), -1, w.shape[1])
                at = act.argmax(1)
                top = np.take_along_axis(act, at[:, None], 1)[:, 0] + b
                hidden = np.maximum(top, 0)
                logits = hidden @ v + c
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(x)), y] -= 1
                p /= len(x)
                dh = (p @ v.T) * (top > 0)
                rows = at + np.arange(len(x))[:, None] * act.shape[1]
                picked = col[rows]
                dw = np.einsum("nf,nfk->kf", dh, picked, optimize=True) * self.mask
                dx = (dh[:, :, None] * w.T[None]).reshape(-1, WIDEST, DEPTH)
                bytes_ = x[np.arange(len(x))[:, None, None], (at * STRIDE)[:, :, None] + np.arange(WIDEST)].reshape(-1)
                dx = dx.reshape(-1, DEPTH)
                de = np.stack([np.bincount(bytes_, dx[:, d], 256) for d in range(DEPTH)], 1).astype(np.float32)
                t += 1
                now = rate * (1 - 0.9 * t / rounds)
                for i, g in enumerate((de, dw, dh.sum(0), hidden.T @ p, p.sum(0))):
                    first[i] += 0.1 * (g - first[i])
                    second[i] += 0.01 * (g * g - second[i])
                    self.weights[i] = self.weights[i] - (now * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)


class Model:
    """A trained network with the languages it tells apart."""

    def __init__(self, rows: list[tuple[str, str]], counts: dict[str, int], steps: tuple[int, int] = STEPS):
        """``rows``: (language, text) of labelled documents; ``counts``: documents per language in the whole collection.

        Labels may be wrong and documents mixed. After a first fit, languages whose
        documents the network takes for others are given up (their labels name
        nothing of their own; ``report`` says which) and sentences that clearly
        contradict their label are left out of the second fit. ``steps`` are counted
        per language. The first fit's margins on documents held out from it say how sure
        a margin is; the second fit is on all documents.
        """
        pieces, names, docs, rng = [], [], [], np.random.default_rng(7)
        for k, (lang, text) in enumerate(rows):
            own = [text[a:b] for a, b in sentences(text)]
            pieces += [accented(p, rng) if k % 6 == 0 else p for k, p in enumerate(own)]
            names += [lang] * len(own)
            docs += [k] * len(own)
        self.langs = sorted(set(names))
        #: (language, documents that state it, of these sampled, share of sampled sentences that the first fit agrees with, kept)
        self.report = [(x, n, 0, None, False) for x, n in counts.items() if x not in self.langs]
        self.slope, self.shift = 1.0, 0.0
        win, n = windows(pieces)
        y = np.array([self.langs.index(x) for x in names], np.int64)
        self.net = Network(max(1, len(self.langs)))
        sampled = [sum(lang == x for lang, _ in rows) for x in self.langs]
        if len(self.langs) < 2:
            self.report += [(x, counts.get(x, k), k, None, True) for x, k in zip(self.langs, sampled)]
            return
        times = max(LEAST_LANGUAGES, len(self.langs))
        docs = np.array(docs)
        held = docs % HELD_OUT == HELD_OUT - 1
        use = np.repeat(~held, n)
        self.net.fit(win[use], np.repeat(y, n)[use], steps[0] * times, 1)
        scores = self.sums(win, n)
        prior = np.log([counts.get(x, 1) / k for x, k in zip(self.langs, sampled)])  # the fit knows the rest
        guess = (scores + prior).argmax(1)
        agreed = [float((guess[y == k] == k).mean()) for k in range(len(self.langs))]
        self.report += [(x, counts.get(x, k), k, a, a >= 0.5) for x, k, a in zip(self.langs, sampled, agreed)]
        own = np.array([a >= 0.5 for a in agreed])
        keep = own[y] & (scores[np.arange(len(y)), y] > scores.max(1) - 3)
        # held-out documents whose label most of their sentences confirm
        agree = np.bincount(docs, keep, len(rows)) * 2 > np.bincount(docs, minlength=len(rows))
        tried = np.flatnonzero(held & agree[docs] & own[y])
        if len(tried) >= 50:  # whole sentences and beginnings of them, so that there are doubtful ones too
            some = [p for k in tried for p in (pieces[k], pieces[k][: rng.integers(6, 40)])]
            part = self.sums(*windows(some))
            two = np.sort(part, 1)[:, -2:]
            self._calibrate(two[:, 1] - two[:, 0], part.argmax(1) == np.repeat(y[tried], 2))
        left = [x for x, a in zip(self.langs, agreed) if a >= 0.5]
        again = np.array([left.index(x) if x in left else -1 for x in self.langs])[y]
        self.langs = left
        self.net = Network(max(1, len(left)), seed=6)
        use = np.repeat(keep, n)
        if len(left) > 1:
            self.net.fit(win[use], np.repeat(again, n)[use], steps[1] * times, 2)

    def pack(self) -> bytes:
        """Everything that applying the model needs, as bytes."""
        out = io.BytesIO()
        np.savez_compressed(out, *self.net.weights)
        plain = {"langs": self.langs, "report": self.report, "slope": self.slope, "shift": self.shift}
        head = json.dumps(plain).encode()
        return len(head).to_bytes(8, "big") + head + out.getvalue()

    @classmethod
    def unpack(cls, raw: bytes) -> Model:
        size = int.from_bytes(raw[:8], "big")
        plain = json.loads(raw[8 : 8 + size])
        model = cls([], {})
        model.langs, model.slope, model.shift = plain["langs"], plain["slope"], plain["shift"]
        model.report = [tuple(x) for x in plain["report"]]
        with np.load(io.BytesIO(raw[8 + size :])) as stored:
            weights = [stored[k] for k in stored.files]
        model.net = Network(weights[-1].shape[0])
        model.net.weights = weights
        return model

    def _calibrate(self, margin: np.ndarray, right: np.ndarray) -> None:
        """Logistic curve from the margin of a sentence to the share of right ones (Newton's method, a little ridge)."""
        x = np.stack([np.minimum(margin, 30) / 10, np.ones(len(margin))], 1)
        goal = np.where(right, 1 - 1 / (right.sum() + 2), 1 / ((~right).sum() + 2))
        w = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ w))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (goal - p) - 1e-2 * w)
            w = w + np.clip(step, -2, 2)
        self.slope, self.shift = float(max(w[0], 0.0)) / 10, float(w[1])

    def sure(self, margin: np.ndarray) -> np.ndarray:
        """Confidence of sentences whose language leads the others by ``margin`` nats (less than 0: it does not lead)."""
        best = 1 / (1 + np.exp(-(self.slope * np.minimum(np.abs(margin), 30) + self.shift)))
        return np.where(margin >= 0, best, 1 - best)

    def sums(self, win: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log-probabilities of each piece: the sum over its windows."""
        logs = np.maximum(self.net.log_probs(win), -8.0)
        total = np.concatenate([np.zeros((1, logs.shape[1])), np.cumsum(logs, 0, dtype=np.float64)])
        ends = np.concatenate([[0], np.cumsum(n)])
        return total[ends[1:]] - total[ends[:-1]]

    def stretches(self, texts: list[str | None], outside: bool = False) -> list[list[tuple[int, int, str, float, bool]]]:
        """(begin, end, language, confidence, whole sentence) of the stretches of each text.

        ``outside``: with the title line and the closing section, which hold no whole
        sentence. Confidence is the mean over a stretch's sentences, by length.
        """
        spans = []
        for t in texts:
            own = [(a, b, True) for a, b in sentences(t)] if t else []
            if t and outside:
                before, behind = ([(a, b, False) for a, b in lines if _LETTERS.search(t, a, b)] for lines in outside_lines(t))
                own = before + own + behind
            spans.append(own)
        win, n = windows([t[a:b] for t, ss in zip(texts, spans) for a, b, _ in ss])
        scores = self.sums(win, n) if self.langs else np.zeros((len(n), 0))
        best = scores.argmax(1) if len(self.langs) else np.zeros(len(n), np.int64)
        out, k = [], 0
        for text, ss in zip(texts, spans):
            own, choice = scores[k : k + len(ss)], best[k : k + len(ss)]
            k += len(ss)
            if not ss or not self.langs:
                out.append([])
                continue
            if (choice != choice[0]).any():
                choice = cheapest(own, SWITCH)
            runs, i = [], 0
            for j in range(1, len(ss) + 1):
                if j == len(ss) or choice[j] != choice[i]:
                    part = own[i:j]
                    lang = int(choice[i])
                    others = np.delete(part, lang, 1).max(1) if part.shape[1] > 1 else np.full(len(part), -30.0)
                    margin = part[:, lang] - others
                    sure = float(np.average(self.sure(margin), weights=[b - a for a, b, _ in ss[i:j]]))
                    whole = any(m >= SURE and body and whole_sentence(text[a:b]) for m, (a, b, body) in zip(margin, ss[i:j]))
                    runs.append((ss[i][0], ss[j - 1][1], self.langs[lang], sure, whole))
                    i = j
            out.append(runs)
        return out

    def languages(self, texts: list[str | None]) -> list[tuple[str | None, float]]:
        """(language, confidence) of each text: that of its longest language, by all its lines; (None, 0) without letters.

        A text without a piece of four letters is taken whole. Confidence is the share of the
        language's stretches in the text, each weighed by its own confidence.
        """
        runs = self.stretches(texts, True)
        short = [i for i, (t, r) in enumerate(zip(texts, runs)) if not r and t and any(ch.isalpha() for ch in t)]
        if short and self.langs:
            win, n = windows([texts[i].strip() for i in short])
            two = np.sort(scores := self.sums(win, n), 1)[:, -2:]
            margin = two[:, 1] - two[:, 0] if two.shape[1] > 1 else np.full(len(two), 30.0)
            for i, lang, sure in zip(short, scores.argmax(1), self.sure(margin)):
                runs[i] = [(0, len(texts[i]), self.langs[lang], float(sure), False)]
        out: list[tuple[str | None, float]] = []
        for found in runs:
            size, sure = {}, {}
            for a, b, lang, c, _ in found:
                size[lang] = size.get(lang, 0) + b - a
                sure[lang] = sure.get(lang, 0.0) + c * (b - a)
            lang = max(size, key=lambda x: (size[x], x)) if size else None
            out.append((lang, sure[lang] / sum(size.values()) if lang else 0.0))
        return out


def whole_sentence(piece: str) -> bool:
    """Whether a unit can be a whole sentence: three words or more, or six signs of a script that sets none apart."""
    return len(piece.split()) >= 3 or (_SPACELESS.search(piece) is not None and len(piece.strip()) >= 6)


def cheapest(scores: np.ndarray, switch: float) -> np.ndarray:
    """Language of each sentence on the path with the most log-probability less ``switch`` a change."""
    total, back = scores[0], []
    for row in scores[1:]:
        top = int(total.argmax())
        stay = total >= total[top] - switch
        back.append(np.where(stay, np.arange(len(total)), top))
        total = np.where(stay, total, total[top] - switch) + row
    path = [int(total.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def _stored(documents: DataFrame, name: str, build: Callable[[], Model]) -> Model:
    """The model kept under ``name`` in the shared folder, built and kept if there is none."""
    spark = documents.sparkSession
    path = f"{shared_dir(spark)}/arcweave-language-model-{name}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        spark.createDataFrame([(bytearray(build().pack()),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)
    return Model.unpack(bytes(spark.read.schema("model binary").parquet(path).first()["model"]))


def fit(documents: DataFrame, sample: int = SAMPLE, steps: tuple[int, int] = STEPS) -> Model:
    """Train on at most ``sample`` labelled documents per language, chosen by hash.

    The documents of a language are first thinned at random to about twice the
    sample, so no task ranks all documents of a frequent language. The trained model
    is kept in the shared folder under a fingerprint of all labelled documents and the
    parameters, so later queries over the same documents read it instead of fitting.
    """
    rows = documents.where("text is not null and text <> ''").select(label_column(F.col("lang")).alias("l"), "doc_id", "text").where("l is not null")
    each = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc_id", "text")).alias("x")).collect()
    counts = {r["l"]: r["n"] for r in each}
    if not counts:
        return Model([], {})

    def build() -> Model:
        share = F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, min(1.0, (2.0 * sample + 20) / n))])[F.col("l")]
        draw = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        some = rows.where(draw < share).withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64(F.lit(4), "doc_id"), "doc_id"))).where(F.col("r") <= sample)
        return Model([(r["l"], r["text"]) for r in some.orderBy("l", "r").select("l", "text").collect()], counts, steps)

    known = repr((sorted((r["l"], r["n"], r["x"]) for r in each), sample, steps, WINDOW, DEPTH, STRIDE, sorted(WIDTHS.items()), HELD_OUT, LEAST_LANGUAGES))
    return _stored(documents, hashlib.sha256(known.encode()).hexdigest()[:32], build)


def language_report(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """``(lang, n_documents, n_sampled, agreed, kept)``: every language that a label states, and whether it was kept.

    A language is given up (``kept`` false) if less than half of its sampled sentences
    are taken for it, or if no document of it has a sentence; its documents come out
    in the languages they are taken for.
    """
    model = model or fit(documents)
    return documents.sparkSession.createDataFrame(sorted(model.report), "lang string, n_documents bigint, n_sampled bigint, agreed double, kept boolean")


def language_stretches(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, begin, end, lang, confidence, whole)``: the stretches of every document in text order.

    Adjacent sentences of one language form a stretch (offsets in code points);
    ``whole`` says that at least one whole sentence of the body speaks clearly for it.
    The title line and the lines of a closing section are read too, each as one
    piece; pieces without letters belong to no stretch; null, blank and number-only
    texts give no rows. Whole texts are read. ``lang`` may be null or wrong; it is
    only used for fitting, see ``fit``. Repeated rows come out again, other columns
    are ignored.
    """
    return _labelled_stretches(documents, model, True).drop("stated")


def document_languages(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, lang, confidence)``: one row for every row of ``documents``.

    The language of most of the text, title and closing lines included; null with
    confidence 0 for null and blank texts and those without a letter. Repeated rows
    come out again, other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model or fit(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 500):
                ids, texts = (c.to_pylist() for c in batch.slice(k, 500).columns)
                cols = list(zip(*((i, *x) for i, x in zip(ids, shared.value.languages(texts)))))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.float64()))], names=["doc_id", "lang", "confidence"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang string, confidence double")


def _labelled_stretches(documents: DataFrame, model: Model | None, outside: bool = False) -> DataFrame:
    """The stretches with ``stated``, the language that the document's label states."""
    shared = documents.sparkSession.sparkContext.broadcast(model or fit(documents))
    kinds = {"doc_id": pa.int64(), "begin": pa.int32(), "end": pa.int32(), "lang": pa.string(), "confidence": pa.float64(), "whole": pa.bool_(), "stated": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 500):
                ids, texts, labels = (c.to_pylist() for c in batch.slice(k, 500).columns)
                rows = [(i, *x, label_code(l)) for i, l, runs in zip(ids, labels, shared.value.stretches(texts, outside)) for x in runs]
                cols = list(zip(*rows)) if rows else [[]] * len(kinds)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds.values())], names=list(kinds))

    rows = documents.where("text is not null").select("doc_id", "text", "lang")
    return rows.mapInArrow(run, "doc_id bigint, begin int, end int, lang string, confidence double, whole boolean, stated string")


def unstated_languages(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, lang)``: languages that a document holds in a whole sentence and its label does not state."""
    found = _labelled_stretches(documents, model).where("whole and (stated is null or stated <> lang)")
    return found.select("doc_id", "lang").distinct()
