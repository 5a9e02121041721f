"""Sentence units of pages in any language, script and line layout.

A first pass over all texts counts what the collection writes: strings of
spaceless scripts (the dictionary), what stands before and behind their marks
(final particles, opening words), words that open sentences, and tokens before a
full stop (abbreviations). Scripts written without spaces are then cut into the
words of the dictionary's cheapest lattice path, and their gaps judged by final
particles and opening words. Scripts written with spaces: all terminators of a
paragraph form a lattice whose gaps are sure, barred or weighed, and the best path
through it gives the units.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import functions as F

from arcweave.functions.text import TERMINATORS as CLOSING
from arcweave.operators.dedup import once
from arcweave.session import materialize

if TYPE_CHECKING:
    from collections.abc import Callable, Iterator

    from pyspark.sql import DataFrame

# Abbreviations, in lower case and without the final mark.
# Before a name or title; nothing ends here.
TITLES = set("""dr mr mrs ms prof sr sra srta srs dra drs exma exmo sig sigg dott dott.ssa prof.ssa dhr mevr ir ing hr hrn fr frl capt
col gen lt sgt rev hon sen rep pres gov atty adm cmdr maj supt msgr mme mlle mm проф акад г-н г-жа डॉ प्रो श्री د أ م آ jhr mej ds onorev avv don fra""".split())
# Before a number or a reference.
NUMERIC = set("""no nr nos núm n p pp pag pág págs fig figs abb s vol vols ca c ch cap art bd § ff f vgl cf cfr b geb tab kap sec séc
стр рис гл см jan feb mar apr jun jul aug sep sept oct okt nov dec dez bl afb d.h z.b eq eqs thm lem cor prop def sect para tab""".split())
# Inside a name or before a further word; a sentence may still end here before an opening word.
OPEN = set("""st inst dept dep univ soc fdn found govt gov tech bcast mfg manuf eng engng comp natl nat int'l intl lab labs comp ул пл av bzw usw.
dir ee uu e.g i.e approx est tel ext hl bros mt ft resp incl excl z d u a vs""".split())
# At the end of a name or phrase; a sentence may end here.
FINAL = set("""ltd inc corp corpn co coll assn assoc serv svc stud res sci grp cncl jr snr esq etc usw ecc enz p.m a.m u.s u.k d.c b.c a.d ret
т.д т.п др гг г al seq off aff usa""".split())
# Words that go on a name after an abbreviation.
NAME_WORDS = set("""limited ltd co company coll college office serv service council cncl group grp corp corpn corporation association assoc assn
inc stud studies res research sci science aff affairs jr lab institute inst foundation society""".split())
# Function words that open a sentence, per language; further opening words are counted.
OPENERS = set("""the a an in on at by after before near despite according for from with when while what who why how where no two this that
it he she they we as if but and there see
der die das ein eine im am an in nach vor bei trotz was wer warum wie wo als wenn viele es er sie wir dies diese zum zur
le la les un une des en au aux dans pour par selon après avant malgré que qui quoi quel quelle pourquoi il elle ils ce cette
el los las una según tras a qué quién por con pese cuando esta este los
il lo gli uno nel nella per secondo dopo che chi perché nonostante quando questo questa
o os as um uma segundo depois apesar pela pelo quem que em este esta quando
de het een op in na bij voor volgens wie wat waarom hoe toen deze dit
в на по за после до при несмотря впервые кто что почему какая какой как когда""".split())
MONTHS = set("""januar jänner februar märz april mai juni juli august september oktober november dezember january february march may june july
october december""".split())
NAMING = set("called named titled entitled dubbed known heißt genannt appelée appelé nommée llamada llamado chiamata chamada heet genaamd".split())
PAUSE_WORDS = set("ثم و ف لكن और फिर लेकिन تم".split())
# Dictionary of the lattices: speech verbs that close a speaker's clause, particles that carry a quotation on.
SPEECH = set("""问道 说道 问 说 道 喊道 答道 回答 回答道 表示 写道 指出 喊 叫道 述べた 言った 尋ねた 答えた 語った 叫んだ 話した 書いた
पूछा कहा बोला बोली बताया लिखा जोड़ा पुकारा""".split())
CARRY = ("と", "って", "との", "という", "などと")
FUNCTION = set("""在 会上 会议 上 了 的 是 他 她 对 向 着 并 の に は が を で も から まで 会議 記者 彼 彼女 人々 それ""".split()) | SPEECH | set(CARRY)

# Final particles and endings that close a clause in Chinese and Japanese; further ones are counted.
FINALS = set("了 吗 呢 吧 啊 呀 嘛 です ます ました でした ません だった した だ た ない か よ ね ぞ わ".split())
GRAM = 4            # signs of the longest dictionary word
COUNTED = 5         # a string or word must have been seen so often
SHARE = 1e-5        # ... and make up this share of its kind, so no kind has over 100,000 entries
KEPT = 400_000      # different strings a task holds before it gives their counts out

# Marks that always end a sentence: Devanagari, Khmer, Burmese, Ethiopic, Armenian, Urdu, and the Greek question mark.
FULL = "।॥។៕။።፧։۔\u037e"
_MARKS = re.compile(rf"(?:[.!?؟…]|。|！|？|｡|[{FULL}]|(?<=[\u0370-\u03ff\u1f00-\u1fff]);)(?:[\u0020\u00a0\u202f]?[.!?؟…。！？।])*")
_CLOSERS = "\"'”’»“」』）)]›"
_SPACE = " \t     　\r\n​"
_LIST = re.compile(r"(?:[-*•–·‣]|\d{1,3}[.)]|\(?[a-z]\))\s+\S")
_WORD_BEFORE = re.compile(r"[^\s(\[«“„\"‘»”,;:]+$")
_WORD_AFTER = re.compile(r"[«“„\"‘'¿¡(\[]*([^\s.,;:!?…)»”“\"]+)")
_THAI = re.compile("[฀-๿]")
# What had to fit on a line: a word, which ends before a sign of a script that is broken between any two signs; or one such sign.
_FIRST = re.compile(r"[^\s\u3000-\u30ff\u3400-\u9fff\uff00-\uffef]+|\S")


def _cjk(ch: str) -> bool:
    return "぀" <= ch <= "ヿ" or "㐀" <= ch <= "鿿" or "＀" <= ch <= "￯" or "　" <= ch <= "〿"


def _thai(ch: str) -> bool:
    return "฀" <= ch <= "๿"


class Lexicon:
    """What the collection says about its words.

    ``counts`` has (kind, string, n): ``g`` strings of spaceless scripts, ``f`` and ``o``
    those before and behind their sentence marks, ``q`` those before a quotation;
    ``s`` and ``m`` capitalised words that open a line or follow a mark, and those
    inside a sentence; ``w`` short words without a full stop, ``p`` those with one,
    ``l`` of these such that a small letter, a digit or a comma follows.
    """

    def __init__(self, counts: list[tuple[str, str, int]] = ()):
        by: dict[str, dict[str, int]] = {k: {} for k in "gfoqsmwpl"}
        for kind, key, n in counts:
            by[kind][key] = n
        total = sum(by["g"].values()) or 1
        self.cost = {k: math.log(total / n) for k, n in by["g"].items()}
        self.cost |= {w: min(self.cost.get(w, 99.0), 5.0) for w in FUNCTION | FINALS}
        self.unseen = math.log(total) + 6 if len(self.cost) > len(FUNCTION | FINALS) else 8.0
        often = lambda kind, k: by[kind][k] / (by["g"].get(k, 0) + COUNTED)
        self.finals = FINALS | {k for k in by["f"] if often("f", k) >= 0.6}
        self.behind = {k for k in by["o"] if often("o", k) >= 0.3}
        self.speech = SPEECH | {k for k in by["q"] if often("q", k) >= 0.6}
        self.openers = OPENERS | {w for w, n in by["s"].items() if n >= 0.8 * (n + by["m"].get(w, 0))}
        # a token that hardly ever lacks its stop and is not at the end of sentences only
        self.short = {w for w, n in by["p"].items() if by["w"].get(w, 0) * 20 <= n and by["l"].get(w, 0) * 10 >= n}
        # words: mostly without a stop, or with one that a sentence hardly ever goes on after
        self.words = {w for w, n in by["w"].items() if n > by["p"].get(w, 0)} | {w for w, n in by["p"].items() if by["l"].get(w, 0) * 10 < n}

    def split(self, clause: str) -> list[str]:
        """Cheapest path through the lattice of dictionary words; signs in no word cost most."""
        cost, back = [0.0] + [1e18] * len(clause), [0] * (len(clause) + 1)
        for i in range(len(clause)):
            for j in range(i + 1, min(len(clause), i + GRAM) + 1):
                price = self.cost.get(clause[i:j], self.unseen if j == i + 1 else None)
                if price is not None and cost[i] + price < cost[j]:
                    cost[j], back[j] = cost[i] + price, i
        out, j = [], len(clause)
        while j:
            out.append(clause[back[j] : j])
            j = back[j]
        return out[::-1]

    def closes(self, clause: str) -> bool:
        """Whether a clause of a spaceless script ends in a final particle, by the words of its lattice."""
        words = self.split(clause[-12:])
        return bool(words) and (words[-1] in self.finals or any(words[-1].endswith(f) for f in FINALS if len(f) > 1) or "".join(words[-2:]) in self.finals)

    def opens(self, clause: str) -> bool:
        """Whether a clause of a spaceless script begins with a word seen to open sentences."""
        return any(clause.startswith(w) for w in self.behind)


def lattice_words(clause: str) -> list[str]:
    """The words of a clause by the fixed values alone."""
    return _PLAIN.split(clause)


_RUN = re.compile("[\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\u0e00-\u0e7f]+")
_BEFORE_MARK = re.compile("([\u3040-\u30ff\u3400-\u9fff]+)[。！？｡]")
_BEHIND_MARK = re.compile("[。！？｡]([\u3040-\u30ff\u3400-\u9fff]+)")
_BEFORE_QUOTE = re.compile("([\u3040-\u30ff\u3400-\u9fff]+)：[“「]")
_UPPER = "A-ZÀ-ÖØ-Þ\u0100-\u024fΑ-ΩЀ-Я\u0530-\u0556"
_STARTS = re.compile(rf"(?:^|[!?]\s+)[«“„‘¿¡]*([{_UPPER}][^\W\d_'’]*)", re.M)
_INSIDE = re.compile(rf"(?<=[^\W\d_,] )([{_UPPER}][^\W\d_'’]*)")
_TOKEN = re.compile(r"[(\[«“\"„]*([^\W\d_]{1,6})[,;:)]*")
_SHORT = re.compile(r"[(\[«“\"„]*([^\W\d_](?:[^\W\d_]{0,5}|(?:\.[^\W\d_]{1,3})+))\.,?")


def _counts(text: str) -> dict[str, list[str]]:
    """The strings of a text by kind, see ``Lexicon``; ``t`` are its blank-separated tokens, of which ``_kinds`` makes ``w`` and ``p``."""
    out: dict[str, list[str]] = {k: [] for k in "gfoqsml"}
    out["t"] = tokens = text.split()
    if _RUN.search(text):
        for run in _RUN.findall(text):
            for n in range(1, GRAM + 1):
                out["g"] += [run[i : i + n] for i in range(len(run) - n + 1)]
        out["f"] = [r[-n:] for r in _BEFORE_MARK.findall(text) for n in range(1, GRAM + 1) if len(r) >= n]
        out["o"] = [r[:n] for r in _BEHIND_MARK.findall(text) for n in range(2, GRAM + 1) if len(r) >= n]
        out["q"] = [r[-n:] for r in _BEFORE_QUOTE.findall(text) for n in range(1, GRAM + 1) if len(r) >= n]
    out["s"] = [w.lower() for w in _STARTS.findall(text) if w[0].isupper()]
    out["m"] = [w.lower() for w in _INSIDE.findall(text) if w[0].isupper()]
    stopped = [k for k, t in enumerate(tokens) if t.endswith((".", ".,"))]
    for k in stopped:
        if m := _SHORT.fullmatch(tokens[k]):
            nxt = tokens[k + 1][0] if k + 1 < len(tokens) else ""
            if tokens[k].endswith(",") or nxt.islower() or nxt.isdigit():
                out["l"].append(m.group(1).lower())
    return out


def _kinds(tokens: Counter) -> Iterator[tuple[str, str, int]]:
    """Short words without a full stop (``w``) and with one (``p``) among the different tokens."""
    for token, n in tokens.items():
        if m := _TOKEN.fullmatch(token):
            yield "w", m.group(1).lower(), n
        elif m := _SHORT.fullmatch(token):
            yield "p", m.group(1).lower(), n


def _count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = {k: Counter() for k in "gfoqsmlt"}

    def out() -> pa.RecordBatch:
        rows = [(kind, key, n) for kind, c in held.items() if kind != "t" for key, n in c.items()]
        rows += _kinds(held["t"])
        for c in held.values():
            c.clear()
        kinds, keys, n = zip(*rows) if rows else ([], [], [])
        return pa.record_batch([pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(n, pa.int64())], names=["kind", "key", "n"])

    for batch in batches:
        for text in batch.column(0):
            for begin in range(0, len(t := text.as_py() or ""), 1 << 20):
                for kind, found in _counts(t[begin : begin + (1 << 20)]).items():
                    held[kind].update(found)
            if sum(map(len, held.values())) > KEPT:
                yield out()
    yield out()


def learn(pages: DataFrame) -> Lexicon:
    """Count the words of all texts of ``pages`` (column ``text``; null texts have none).

    Tasks send sums, not occurrences. A string comes to the driver if it was seen
    COUNTED times and makes up SHARE of its kind: at most 1 / SHARE strings a kind,
    whatever the size of the collection.
    """
    each = pages.where("text is not null").select("text").mapInArrow(_count_texts, "kind string, key string, n bigint")
    summed = materialize(each.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    whole = summed.groupBy("kind").agg(F.sum("n").alias("all"))
    kept = summed.where(F.col("n") >= COUNTED).join(F.broadcast(whole), "kind").where(F.col("n") >= F.lit(SHARE) * F.col("all"))
    return Lexicon([(r["kind"], r["key"], r["n"]) for r in kept.select("kind", "key", "n").collect()])


def _attribution(text: str, at: int, end: int, lexicon: Lexicon) -> bool:
    """Whether what follows a quotation only names its speaker: a clause that ends in a speech verb, or a few words."""
    m = _MARKS.search(text, at, end)
    clause = text[at : m.start() if m else end].strip(_SPACE)
    if not clause or len(clause) > 120:
        return False
    if _cjk(clause[-1]):
        if clause.startswith(CARRY):
            return True
        head = re.split("[，：“「]", clause)[0][-12:] or " "
        words = lexicon.split(head)
        return lattice_words(head)[-1] in SPEECH or words[-1] in lexicon.speech or "".join(words[-2:]) in lexicon.speech
    words = clause.split()
    return words[-1] in SPEECH and ":" not in clause or len(words) <= 3 and m is not None


def _weigh(text: str, start: int, begin: int, mark: str, stop: int, end: int, lexicon: Lexicon) -> int:
    """How much a gap behind a mark ends a sentence: over 1 surely, under -1 never.

    ``start`` is where the unit began, ``begin`` and ``stop`` where the mark with its
    closing signs begins and stops, ``end`` where the paragraph ends.
    """
    after = stop
    while after < end and text[after] in _SPACE:
        after += 1
    if after >= end:
        return 9
    spaced, nxt = after > stop, text[after]
    closed = text[begin + len(mark) : stop]
    first = mark[0]
    if nxt in ",;:،؛，、；：)]" or (nxt in "—–-" and (closed or mark[0] in "…!?") and not _LIST.match(text, after)):
        return -9
    if nxt.islower():
        return -9
    quoted = closed.strip("   ") != "" and closed.strip()[0] not in ")]）"
    if first in "。！？｡…" and (_cjk(nxt) or _cjk(text[begin - 1]) if begin else False):
        if set(mark) == {"…"}:
            return -9 if len(mark) > 1 and not closed else 9
        if quoted:
            if text.startswith(CARRY, after) and closed.strip()[0] in "」』":
                return -9
            opened = _opening(text, start, begin)
            head = opened <= start or text[opened - 1] not in "：，:,"
            return -9 if head and _attribution(text, after, end, lexicon) else 9
        return 9
    if closed.strip()[-1:] in ")]）" if closed.strip() else False:
        opened = max(text.rfind("(", start, begin), text.rfind("（", start, begin), text.rfind("[", start, begin))
        if opened > start:
            return -9
        return 9
    caseless = not nxt.isupper() and nxt.isalpha() and not nxt.isdigit()
    last = next((ch for ch in reversed(text[max(start, begin - 8) : begin]) if ch.isalpha()), " ")
    unmarked = caseless or last.lower() == last.upper() != " " or first == "।"
    if quoted and unmarked and first in "?؟!।.…":
        opened = _opening(text, start, begin)
        if first in "?؟!" or opened <= start:
            return -9 if _attribution(text, after, end, lexicon) else 9
        return 9
    word_after = _WORD_AFTER.match(text, after)
    word = word_after.group(1) if word_after else ""
    if mark in ("...", "…") or (len(mark) > 1 and set(mark) <= {".", "…"}):
        return -9 if word in PAUSE_WORDS or (caseless and word[:1] == "و") else 9 if spaced or nxt.isupper() else -9
    before = _WORD_BEFORE.search(text, max(start, begin - 40), begin)
    if first in "!?؟":
        if not closed and nxt.isupper() and first in "!?":
            near = re.findall(r"\S+", text[max(start, begin - 60) : begin])
            if any(w.lower() in NAMING for w in near[-4:-1]):
                return -9
        return 9 if spaced or nxt.isupper() or nxt in "«“„‘\"¿¡(" or caseless else -9
    if first in FULL or first == ";":
        return 9
     # A full stop.
    gap = text[max(start, begin - 1)]
    token = before.group() if before and gap not in _SPACE else ""
    low = token.lower().rstrip(".")
    initial = len(word) == 1 and text[after + 1 : after + 2] == "."
    opener = not initial and (word.lower() in lexicon.openers or ("'" in word and word.lower().split("'")[0] in ("l", "d", "un", "nell", "dell", "all", "dall")))
    opener = opener or nxt in "¿¡«“„‘\"("
    if not spaced:
        if nxt.isdigit() or not token or len(low) < 2 or "." in low or low in TITLES or low in OPEN or low in NUMERIC:
            return -9
        return 9 if nxt.isupper() or nxt in "«“„‘¿¡" or (nxt.isalpha() and caseless) else -9
    if not token:
        return 9
    if low in TITLES or (token[:1].isupper() and len(low) <= 6 and word.lower().rstrip(".") in NAME_WORDS and low not in lexicon.words):
        return -9
    if nxt.isdigit() or nxt in "§№":
        if low in NUMERIC or low in OPEN or (len(low) == 1 and low.isalpha()):
            return -9
        return 2 if low in FINAL else 9
    if low.isdigit() and len(low) <= 2:
        if word.lower() in MONTHS:
            return -9
        return -9 if text[start:begin].strip() == low else 9
    if low in NUMERIC:
        return 1 if opener and len(low) > 1 else -9
    if low in FINAL:
        return -9 if word.lower() in NAME_WORDS else 9
    if low in OPEN:
        return 2 if opener and low not in ("z", "d", "u", "a", "bzw") else -9
    if len(low) == 1 and low.isalpha():  # an initial
        return 1 if opener else -2
    if "." in low:  # letters with stops
        return 2 if opener else -2
    if low in lexicon.short:  # the collection writes it with a stop, and goes on
        return 1 if opener else -9
    if 2 <= len(low) <= 4 and token[:1].isupper() and not token.isupper() and low not in lexicon.words and begin - len(token) > start and not opener and nxt.isupper():
        return -2  # a short capitalised token inside a sentence that no text has without a stop
    return 9


def _opening(text: str, start: int, begin: int) -> int:
    return max(text.rfind(q, start, begin) for q in "«“„‘「『\"")


def _closers(text: str, start: int, at: int, end: int) -> int:
    """Where the closing signs after a mark stop."""
    stop = at
    while stop < end:
        ch = text[stop]
        if ch in _CLOSERS:
            if ch == "“" and "„" not in text[start:stop]:
                break
            if ch == '"' and text.count('"', start, stop) % 2 == 0:
                break
            if ch == "'" and "'" not in text[start:stop].replace("s'", "") and "‘" not in text[start:stop]:
                break
            if ch in ")]" and text.count("(", start, stop) + text.count("[", start, stop) == 0:
                break
            stop += 1
        elif ch in "   " and text[stop + 1 : stop + 2] in ("»", "›") and text.count("«", start, stop) > text.count("»", start, stop):
            stop += 2
        else:
            break
    return stop


def _paragraph(text: str, start: int, end: int, lexicon: Lexicon) -> list[tuple[int, int]]:
    """Units of a paragraph: the best path through its terminators."""
    units, at, weighed = [], start, []
    pos = start
    while True:
        m = _MARKS.search(text, pos, end)
        if not m:
            break
        stop = _closers(text, at, m.end(), end)
        mark = m.group()
        if len(mark) > 1:
            mark = "".join(mark.split())
        score = _weigh(text, at, m.start(), mark, stop, end, lexicon) if m.start() > at or mark[0] in "…." else -9
        if m.start() == at and score > 1:
            score = -9  # a mark that begins a unit ends nothing
        if score > 2:
            units += _weighed(text, at, stop, weighed)
            at, weighed = stop, []
            while at < end and text[at] in _SPACE:
                at += 1
        elif score > -9:
            weighed.append((stop, score))
        pos = max(stop, m.end())
    if at < end:
        units += _weighed(text, at, end, weighed)
    if _THAI.search(text, start, end):
        units = [u for a, b in units for u in _thai_units(text, a, b)]
    return [u for a, b in units for u in _unmarked(text, a, b, lexicon)]


def _weighed(text: str, start: int, end: int, gaps: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Between two sure breaks: the path with the greatest sum of weights, where a piece of under three words costs 2."""
    if not gaps:
        return [(start, end)]
    places = [start, *(g for g, _ in gaps), end]
    best, back = [0] + [-99] * (len(places) - 1), [0] * len(places)
    for j in range(1, len(places)):
        gain = gaps[j - 1][1] if j <= len(gaps) else 0
        for i in range(j):
            piece = best[i] + gain - 2 * (len(text[places[i] : places[j]].split()) < 3)
            if piece > best[j]:
                best[j], back[j] = piece, i
    cuts, j = [], len(places) - 1
    while j:
        cuts.append((places[back[j]], places[j]))
        j = back[j]
    return cuts[::-1]


def _thai_units(text: str, start: int, end: int) -> list[tuple[int, int]]:
    out, at = [], start
    for m in re.finditer(rf"[{_SPACE}]+", text[start:end]):
        a, b = start + m.start(), start + m.end()
        if a <= start or b >= end or text[a - 1].isdigit() or text[b].isdigit():
            continue
        left = text[start:a].rstrip(_CLOSERS + ".!?…ฯๆ")[-1:]
        if _thai(left or "a") and (_thai(text[b]) or text[b] in "“‘\"("):
            out.append((at, a))
            at = b
    return [*out, (at, end)]


_SPACED = re.compile("(?<=[\u3040-\u30ff\u3400-\u9fff])[ \u3000]+(?=[\u3040-\u30ff\u3400-\u9fff])")


def _unmarked(text: str, start: int, end: int, lexicon: Lexicon) -> list[tuple[int, int]]:
    """Gaps without a mark in Chinese and Japanese: a space behind a final particle, or behind any word before one that opens sentences."""
    out, at = [], start
    for m in _SPACED.finditer(text, start, end):
        clause = text[at : m.start()]
        if len(clause) >= 2 and (lexicon.closes(clause) or lexicon.opens(text[m.end() : end])):
            out.append((at, m.start()))
            at = m.end()
    return [*out, (at, end)]


_PLAIN = Lexicon()


def page_lines(text: str) -> list[tuple[int, int]]:
    """Begin and end of the stripped lines of the body, empty ones included (begin = end)."""
    at = len(text) - len(text.lstrip())
    at = text.find("\n", at) + 1 or len(text) + 1
    lines = []
    while at <= len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        line = text[at:stop]
        a = at + len(line) - len(line.lstrip())
        b = at + len(line.rstrip())
        if text.startswith(CLOSING, a):
            break
        lines.append((a, max(a, b)) if b > a else (at, at))
        at = stop + 1
    return lines


def outside_lines(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Begin and end of the stripped lines before the body (the title) and behind it (a closing section)."""
    parts: list[list[tuple[int, int]]] = [[], []]
    at, behind = 0, False
    body = text.find("\n", len(text) - len(text.lstrip())) + 1 or len(text) + 1
    while at <= len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        line = text[at:stop]
        a, b = at + len(line) - len(line.lstrip()), at + len(line.rstrip())
        behind = behind or (at >= body and text.startswith(CLOSING, a))
        if b > a and (behind or at < body):
            parts[behind].append((a, b))
        at = stop + 1
    return parts[0], parts[1]


def paragraphs(text: str) -> list[tuple[int, int, bool]]:
    """(begin, end, whole) of the paragraphs of the body; ``whole``: a list line, one unit.

    Lines are joined where a paragraph was wrapped: neither is a list line and the
    next line's first word would not have fitted on the line before, at the width
    of the block's longest line. In Chinese and Japanese, where a line may break
    between any two signs, the first sign is that word.
    """
    out: list[tuple[int, int, bool]] = []
    block: list[tuple[int, int]] = []

    def close() -> None:
        width = max((b - a for a, b in block), default=0)
        for k, (a, b) in enumerate(block):
            item = bool(_LIST.match(text, a, b))
            if k and not item and not out[-1][2] and 40 <= width <= 160:
                before = block[k - 1]
                word = _FIRST.match(text, a, b).group()
                runs_on = before[1] - before[0] >= 40 and text[a].islower() and text[before[1] - 1] not in ".!?…:"
                if runs_on or before[1] - before[0] + 1 + len(word) > width:
                    out[-1] = (out[-1][0], b, False)
                    continue
            out.append((a, b, item))
        block.clear()

    for line in page_lines(text):
        if line[1] > line[0]:
            block.append(line)
        else:
            close()
    close()
    return out


def units(text: str | None, lexicon: Lexicon = _PLAIN) -> list[tuple[int, int]]:
    """Begin and end (code points, end exclusive) of the sentence units of a page; without a lexicon by the fixed values alone."""
    if not text or not text.strip():
        return []
    out = []
    for a, b, whole in paragraphs(text):
        for x, y in [(a, b)] if whole else _paragraph(text, a, b, lexicon):
            piece = text[x:y]
            x += len(piece) - len(piece.lstrip())
            y -= len(piece) - len(piece.rstrip())
            if y > x:
                out.append((x, y))
    return out


def _units_of(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for batch in batches:
            for k in range(0, len(batch), 1000):
                ids, texts = batch.column(0).slice(k, 1000).to_pylist(), batch.column(1).slice(k, 1000).to_pylist()
                rows = [(i, x, y, t[x:y]) for i, t in zip(ids, texts) for x, y in units(t, lexicon)]
                cols = list(zip(*rows)) if rows else [[]] * 4
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string()))],
                    names=["page_id", "start_char", "end_char", "sentence"],
                )

    return run


def sentence_units(pages: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """``(page_id, start_char, end_char, sentence)``: one row per sentence unit and page.

    ``pages`` has ``page_id`` and ``text``; other columns are ignored. Rows
    delivered twice (same id and text) count once; only texts whose hash was seen
    twice are shuffled for that. Line 1 is the title and no
    unit; from the first closing line on there are none. Null, blank and body-less
    texts give no rows. Texts of any length are read whole; the work per page is
    local. ``lexicon`` is learned from the pages unless it is given.
    """
    rows = pages.where("text is not null").select("page_id", "text")
    shared = pages.sparkSession.sparkContext.broadcast(lexicon or learn(rows))
    return once(rows).mapInArrow(_units_of(shared), "page_id bigint, start_char int, end_char int, sentence string")
