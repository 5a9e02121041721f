"""Sentences, leaks, mixing and languages."""

import math
import random

import pytest

from arcweave.llm import langid, leak, mixing, sentences


def cut(text):
    return [text[a:b] for a, b in sentences.units(text)]


@pytest.mark.parametrize(("body", "want"), [
    ("Dr. A. Kron met Prof. Lind at 9.30 a.m. on Friday. He left.", ["Dr. A. Kron met Prof. Lind at 9.30 a.m. on Friday.", "He left."]),
    ("“Why now?” asked Ann. “It holds,” she said. “Go.”", ["“Why now?” asked Ann.", "“It holds,” she said.", "“Go.”"]),
    ("(The older map, ca. 1900, is lost.) It rained... and then stopped. See fig. 3 and pp. 4 ff. there.",
     ["(The older map, ca. 1900, is lost.)", "It rained... and then stopped.", "See fig. 3 and pp. 4 ff. there."]),
    ("The firm is called Yes! Boats and thrives. It rose 3.5 per cent, i.e. more.Then it fell .", ["The firm is called Yes! Boats and thrives.", "It rose 3.5 per cent, i.e. more.", "Then it fell ."]),
    ("Am 3. Mai kam er, d. h. spät. „Wer?“, fragte sie. „Ich.“ Er ging.", ["Am 3. Mai kam er, d. h. spät.", "„Wer?“, fragte sie.", "„Ich.“", "Er ging."]),
    ("« Qui ? » demanda-t-il. « Moi. » Il partit.", ["« Qui ? » demanda-t-il.", "« Moi. »", "Il partit."]),
    ("“门为什么开着？”林问道。林说：“走吧。”他走了……后来雾散了。花了3.5元…完了！", ["“门为什么开着？”林问道。", "林说：“走吧。”", "他走了……后来雾散了。", "花了3.5元…", "完了！"]),
    ("「なぜ？」とリンは尋ねた。彼は「行く。」と述べた。雨だ。", ["「なぜ？」とリンは尋ねた。", "彼は「行く。」と述べた。", "雨だ。"]),
    ("“फाटक खुला क्यों था?” अमर ने पूछा। वह गया।", ["“फाटक खुला क्यों था?” अमर ने पूछा।", "वह गया।"]),
    ("سأل د. كرم: «لماذا؟» في الجلسة. ذهب.", ["سأل د. كرم: «لماذا؟» في الجلسة.", "ذهب."]),
    ("ในปี 1830 เขาซื้อ 50 บ่อ เขากลับบ้าน", ["ในปี 1830 เขาซื้อ 50 บ่อ", "เขากลับบ้าน"]),
    ("Early years\n\n1. First item. Still the item.\n- Second\nReferences\nnothing", ["Early years", "1. First item. Still the item.", "- Second"]),
])
def test_units(body, want):
    assert cut("Title\n" + body) == want


def test_wrapped_lines_and_offsets():
    text = "\n  T\r\nThis paragraph was wrapped to a width of sixty columns, so its lines\r\nend within the sentence. A second one ends where the paragraph\r\nends.\r\n\r\nNotesworthy: nothing after it\r\nmore"
    got = cut(text)
    assert len(got) == 2 and got[0].endswith("sentence.") and got[1].startswith("A second") and got[1].endswith("ends.")


def test_wrapped_lines_without_spaces():
    long = "珂珂说：“我们天亮以前出发。”考察队检查了五口水井，这是没有人预料到的。农民失去了大部分收成，船员们等着。"
    assert cut("题\n地理\n" + long)[:2] == ["地理", "珂珂说：“我们天亮以前出发。”"]
    assert cut("题\n地理\nKerem说" + long[3:])[:2] == ["地理", "Kerem说：“我们天亮以前出发。”"]
    body = "長い遅れの後、渡し船は穀物と塩を運んでいたが、それは誰も予想していなかった。調査隊は五十か所の井戸を調べた。指数は上がった。"
    wrapped = body[:45] + "\n" + body[45:]
    assert [u.replace("\n", "") for u in cut("題\n" + wrapped)] == cut("題\n" + body)


@pytest.mark.parametrize("text", [None, "", " \n", "Title", "Title\n\n \n", "Title\nSee also\nx", "T\n" + "." * 50, "T\n" + "a" * 200_000, "T\n" + "Ein Satz. " * 20_000])
def test_every_sign_is_in_one_unit(text):
    units = sentences.units(text)
    assert all(a < b for a, b in units) and all(x[1] <= y[0] for x, y in zip(units, units[1:]))
    if text and "\n" in text:
        inside = "".join(text[a:b] for a, b in units)
        body = "".join(text[a:b] for a, b in sentences.page_lines(text))
        assert "".join(inside.split()) == "".join(body.split())


def test_random_bodies_are_covered():
    rng = random.Random(2)
    parts = ["Dr.", "A.", "“", "”", "...", "！", "。", "Wort", "satz", " ", "\n", "(", ")", "3.", "?", "»", "«", "ไทย", "桥", "…", "Ltd.", "'", '"', "„"]
    for _ in range(400):
        text = "T\n" + "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        inside = "".join(text[a:b] for a, b in sentences.units(text))
        assert "".join(inside.split()) == "".join("".join(text[a:b] for a, b in sentences.page_lines(text)).split())


@pytest.mark.parametrize(("body", "want"), [
    ("I met Gov. Smith and Atty. Gen. Jones. He left.", ["I met Gov. Smith and Atty. Gen. Jones.", "He left."]),
    ("See Eq. Two and Thm. Four. The rest is proved.", ["See Eq. Two and Thm. Four.", "The rest is proved."]),
    ("彼は東京へ行きました 昨日は雨でした 今日は晴れです", ["彼は東京へ行きました", "昨日は雨でした", "今日は晴れです"]),
    ("他来了 我们走了 天黑了", ["他来了", "我们走了", "天黑了"]),
    ("នាងទៅផ្ទះ។ គាត់មក។", ["នាងទៅផ្ទះ។", "គាត់មក។"]),
    ("သူသွားသည်။ သူမလာသည်။", ["သူသွားသည်။", "သူမလာသည်။"]),
    ("ልጁ ሄደ። እሷ መጣች።", ["ልጁ ሄደ።", "እሷ መጣች።"]),
    ("Πού πας; Πάω σπίτι. Ήρθε; Ναι.", ["Πού πας;", "Πάω σπίτι.", "Ήρθε;", "Ναι."]),
    ("وہ گیا۔ وہ آئی۔", ["وہ گیا۔", "وہ آئی۔"]),
    ("She came; he left. It rained.", ["She came; he left.", "It rained."]),
    ("她在Port 3 北边 看书。他走了。", ["她在Port 3 北边 看书。", "他走了。"]),
])
def test_texts_of_other_kinds(body, want):
    assert cut("Title\n" + body) == want


def test_lexicon_is_learned(spark):
    texts = [f"T\nThe Zlm. Bron {k} was built, zk. early. Zumal came.\nDann ging Zumal fort. Zumal ging.\n" + "桥梁稳固嘞。天色暗下来嘞。小船" * 3 + "开走嘞。" for k in range(30)]
    texts += ["T\nThe Zlm. 9 of Bron, the zk. late one."] * 30
    lexicon = sentences.learn(spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string"))
    assert {"zlm", "zk"} <= lexicon.short and "嘞" in lexicon.finals and "the" in lexicon.openers and "dann" in lexicon.openers and "zumal" not in lexicon.openers
    assert "桥梁稳固" in lexicon.split("桥梁稳固嘞") and "".join(lexicon.split("天色暗下来x嘞")) == "天色暗下来x嘞"
    read = lambda body: [t[a:b] for t in ["T\n" + body] for a, b in sentences.units(t, lexicon)]
    assert read("We saw Zlm. Dorn there. It fell.") == ["We saw Zlm. Dorn there.", "It fell."]
    assert read("门开嘞 雨停嘞 人走") == ["门开嘞", "雨停嘞", "人走"] and cut("T\n门开嘞 雨停嘞 人走") == ["门开嘞 雨停嘞 人走"]
    assert sentences.learn(spark.createDataFrame([], "text string")).split("桥") == ["桥"]


def test_sentence_rows(spark):
    rows = [(1, "T\nOne. Two.", "x"), (1, "T\nOne. Two.", "y"), (2, None, "x"), (None, "T\nOne.", "x")]
    df = spark.createDataFrame(rows, "page_id bigint, text string, sentence string")
    assert sorted(map(tuple, sentences.sentence_units(df).collect()), key=str) == [(1, 2, 6, "One."), (1, 7, 11, "Two."), (None, 2, 6, "One.")]
    assert sentences.sentence_units(df.limit(0)).count() == 0


ITEM = "the night baker described at length two marble lions while the orchestra was tuning in the old harbour hall of the northern town"


def held(words, text, part=0.5):
    """Longest common subsequence of an item with any window of one and a half times its length."""
    best, width = 0, int(1.5 * len(words) + 0.5)
    for start in range(len(text)):
        row = [0] * (len(words) + 1)
        for w in text[start : start + width]:
            for j in range(len(words), 0, -1):
                row[j] = row[j]
            new = [0]
            for j, x in enumerate(words, 1):
                new.append(row[j - 1] + 1 if x == w else max(row[j], new[-1]))
            row = new
        best = max(best, row[-1])
    return best >= part * len(words)


def test_leaks(spark):
    words = ITEM.split()
    rng = random.Random(4)
    other = "a ferry carried grain and salt to the island before snow fell although budget was cut by council".split()
    docs = []
    for k in range(60):
        take = words[: rng.randrange(4, len(words) + 1)]
        for _ in range(rng.randrange(3)):
            take.insert(rng.randrange(len(take)), "<b>very</b>")
        text = [rng.choice(other) for _ in range(30)]
        at = rng.randrange(30)
        docs.append((k, " ".join(text[:at] + take + text[at:]).upper() if k % 2 else ",  ".join(text[:at] + take + text[at:])))
    zh = "最年轻的竖琴手没有一个证人拍卖了一箱没熟的梨"
    docs += [(100, None), (101, ""), (102, "前文。" + zh + "后文。"), (103, zh[:5]), (None, ITEM), (104, ITEM + " x" * 300_000), (105, ITEM)]
    rows = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, item_id string, n_words int")
    items = spark.createDataFrame([(1, ITEM, 0), (2, zh, 0), (3, None, 0), (4, "", 0), (5, "two words", 0), (6, "Lions!", 0), (7, "...", 0), (None, ITEM, 0)], "item_id bigint, text string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in leak.leaked(rows, items).collect()}
    tokens = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    want = {(d, 1) for d, t in docs if d is not None and t and d != 104 and held(words, tokens(t))} | {(104, 1), (102, 2)}
    want |= {(d, i) for d, t in docs if d is not None for i, w in ((6, {"lions"}), (5, {"two", "words"})) if w & set(tokens(t or ""))}
    assert got == want and 10 < len([d for d, i in want if i == 1]) < 60
    assert {r.doc_id for r in leak.without_leaks(rows, items).collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert leak.leaked(rows, items.limit(0)).count() == leak.leaked(rows.limit(0), items).count() == 0


def test_leaks_without_runs(spark, monkeypatch):
    monkeypatch.setattr(leak, "HITS", 40, raising=False)
    words = ITEM.split()
    rng = random.Random(6)
    spread = [x for k in range(0, len(words), 2) for x in (*words[k : k + 2], f"w{k}")]  # a word after every second one
    late = [x for w in words[:8] for x in (w, "x")] + words[12:17]  # the first half lies before the only run
    third = [f"c{k}" if k % 3 == 2 else w for k, w in enumerate(words)]  # every third word changed
    docs = [(0, spread), (1, late), (2, words[::3]), (3, third)]
    for k in range(4, 120):
        text = [rng.choice(words) if rng.random() < 0.2 else f"w{k}" for _ in range(60)]
        n = rng.randrange(7, 14)
        for place, w in zip(sorted(rng.sample(range(36), n)), sorted(rng.sample(range(len(words)), n))):
            text[place + 10] = words[w]
        docs.append((k, text))
    rows = spark.createDataFrame([(k, " ".join(t)) for k, t in docs], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, ITEM), (2, "no such words at all")], "item_id bigint, text string")
    want = {k for k, t in docs if held(words, t)}
    assert {0, 1, 3} < want and 2 not in want and 10 < len(want) < 110
    assert {(r.doc_id, r.item_id) for r in leak.leaked(rows, items).collect()} == {(k, 1) for k in want}


def test_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(leak, "ITEM_BLOCK", 50)
    items = spark.createDataFrame([(k, f"{ITEM} number {k} and so on") for k in range(4)], "item_id bigint, text string")
    docs = spark.createDataFrame([(9, f"{ITEM} number 2 and so on")], "doc_id bigint, text string")
    assert sorted(r.item_id for r in leak.leaked(docs, items.union(items.limit(1))).collect()) == [0, 0, 1, 2, 3]
    assert [tuple(r) for r in leak.whole_leaks(docs, items).collect()] == [(9, 2)]


def test_mix_plan():
    tokens, goal, repeats = {"a": 1000, "b": 100, "c": 0}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 4, "c": 2}
    plan = mixing.plan_mix(tokens, goal, repeats)
    assert set(plan) == {"a", "b"} and math.isclose(plan["a"] / plan["b"], 5 / 3) and math.isclose(plan["b"], 400)
    more = mixing.plan_mix(tokens, goal, repeats, 900)
    assert math.isclose(sum(more.values()), 900) and more["b"] <= 400 + 1e-6 and more["a"] <= 1000
    assert mixing.plan_mix({}, goal, repeats) == {}
    shares = {"a": 0.9, "b": 0.1}
    x = mixing.exponent_for_entropy(shares, 0.6)
    assert 0 < x < 1 and math.isclose(mixing.entropy(mixing.tempered(shares, x)), 0.6, rel_tol=1e-6)


def test_temperature_plan():
    tokens, goal = {"a": 9000, "b": 900, "c": 100}, {"a": 0.5, "b": 0.3, "c": 0.2}
    natural = {s: n / 10_000 for s, n in tokens.items()}
    free = mixing.plan_temperature(tokens, goal, {"a": 1, "b": 99, "c": 99})
    x = mixing.exponent_for_entropy(natural, mixing.entropy(goal))
    assert 0 < x < 1 and all(math.isclose(free[s], 10_000 * w) for s, w in mixing.tempered(natural, x).items())  # the entropy decides
    tight = mixing.plan_temperature(tokens, goal, {"a": 1, "b": 3, "c": 4})
    y = mixing.exponent_for_limits(natural, {"a": 9000, "b": 2700, "c": 400}, 10_000)
    assert x < y < 1 and math.isclose(max(tight["b"] / 2700, tight["c"] / 400), 1, rel_tol=1e-6)  # a limit decides
    assert mixing.plan_temperature({}, goal, {}) == {}


def test_mix(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice("aaaab"), rng.randrange(1, 50)) for k in range(3000)] + [(9000, None, 5), (9001, "z", 5), (9002, "a", 0)]
    counted = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 3), ("gone", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(counted, targets).cache()
    assert mixed.groupBy("doc_id", "copy").count().where("count > 1").count() == 0
    assert mixing.mix_checks(counted, targets, mixed).first().asDict() == {"over_limit": 0, "off_target": 0, "unplaced": 0}
    bad = mixed.unionByName(mixed.where("source = 'a'").withColumn("place", mixing.F.col("place") + 1))
    assert min(mixing.mix_checks(counted, targets, bad).select("over_limit", "off_target").first()) > 0
    cut = mixing.mix(counted, targets, block_tokens=500).orderBy("block", "place").collect()
    starts = [r.block * 500 + r.place for r in cut]
    assert starts[0] == 0 and all(y - x == r.n_tokens for x, y, r in zip(starts, starts[1:], cut)) and 5 < len({r.source for r in cut[:40]}) * 5
    report = {r.source: r for r in mixing.mix_report(counted, targets, mixed).collect()}
    assert set(report) == {"a", "b", "gone"} and report["gone"].mixed_tokens == 0
    assert abs(report["a"].share - 0.6) < 0.003 and report["a"].most_copies <= 1 and report["b"].most_copies <= 3
    assert mixing.mix(counted.limit(0), targets).count() == mixing.mix(counted, targets.limit(0)).count() == 0


def test_tokens(spark):
    docs = spark.createDataFrame([(1, "a", "Hello, world 漢字"), (2, "a", None), (3, None, "")], "doc_id bigint, source string, text string")
    got = {r.doc_id: r.n_tokens for r in mixing.count_tokens(docs).collect()}
    assert got[1] >= 4 and got[2] == got[3] == 0


PHRASES = {
    "en": "the council sold the old mill;farmers lost most of the harvest;after a long delay the bridge was closed;she wrote a history of the lighthouse",
    "de": "der Rat verkaufte die alte Mühle;die Bauern verloren fast ihre ganze Ernte;nach langer Zeit wurde die Brücke gesperrt;sie schrieb eine Geschichte des Leuchtturms",
    "ru": "совет продал старую мельницу;крестьяне потеряли весь урожай;после долгой задержки мост закрыли;она написала историю маяка",
    "th": "สภาเมืองขายโรงสีเก่า;ชาวนาสูญเสียผลผลิต;สะพานถูกปิดเพื่อซ่อมแซม;เขาเขียนประวัติของประภาคาร",
}


def documents(seed=1, n=240):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lang = rng.choice(list(PHRASES))
        body = [f"{rng.choice(PHRASES[lang].split(';'))} {rng.randrange(90)}" for _ in range(5)]
        out.append((k, "Title\n" + "\n".join(b[0].upper() + b[1:] + "." for b in body), lang))
    return out


def test_labels(spark):
    for label, want in [("EN", "en"), ("en_GB", "en"), ("deu", "de"), ("German", "de"), ("pt-BR", "pt"), ("und", None), ("", None), (None, None), ("xx", None)]:
        assert langid.label_code(label) == want
        assert spark.createDataFrame([(label,)], "l string").select(langid.label_column(langid.F.col("l"))).first()[0] == want


def test_languages(spark):
    rows = documents()
    mixed = "Title\nThe council sold the old mill. Farmers lost most of the harvest.\nКрестьяне потеряли весь урожай. Она написала историю маяка.\nReferences\nder Rat verkaufte die alte Mühle"
    wrong = [(500, rows[0][1], "fr"), (501, mixed, "English"), (502, None, "en"), (503, "", None), (504, "1998 | 3\n4 | 5", None), (None, rows[1][1], None)]
    df = spark.createDataFrame([(*r, "x") for r in rows + wrong], "doc_id bigint, text string, lang string, begin string")
    model = langid.fit(df, 40, (19, 31))
    assert set(model.langs) == set(PHRASES)
    got = {(r.doc_id, r.lang) for r in langid.unstated_languages(df, model).collect()}
    assert (500, rows[0][2]) in got and (501, "ru") in got and not any(d in (502, 503, 504) for d, _ in got)
    assert len([d for d, _ in got if d is not None and d < 500]) <= 3
    runs = [r for r in langid.language_stretches(df, model).where("doc_id = 501").orderBy("begin").collect()]
    assert [r.lang for r in runs][:2] == ["en", "ru"] and [r.whole for r in runs][:2] == [True, True] and all(0.5 < r.confidence <= 1 for r in runs)
    assert langid.unstated_languages(df.limit(0)).count() == 0
    assert {r.lang: r.kept for r in langid.language_report(df, model).collect()} == {**dict.fromkeys(PHRASES, True), "fr": False}
    outside = [r for r in langid.language_stretches(df, model).where("doc_id = 501").orderBy("begin").collect()]
    assert mixed[outside[-1].begin : outside[-1].end].endswith("Mühle") and not outside[-1].whole or outside[-1].lang == "ru"


def test_document_languages(spark):
    rows = documents(n=160)
    more = [(500, "Der Rat verkaufte die alte Mühle nach langer Zeit", None), (501, None, "en"), (502, " \n", "en"), (503, "1998 | 3", "en"), (504, "мак", None), (None, rows[0][1], None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows + more], "doc_id bigint, text string, lang string, confidence double")
    model = langid.fit(df, 40, (19, 31))
    got = {r.doc_id: (r.lang, r.confidence) for r in langid.document_languages(df, model).collect()}
    assert len(got) == len(rows) + len(more) and all(0 <= c <= 1 for _, c in got.values())
    assert got[500][0] == "de" and got[504][0] == "ru" and [got[k] for k in (501, 502, 503)] == [(None, 0.0)] * 3
    assert sum(got[k][0] == lang for k, _, lang in rows) >= 157
    again = langid.Model.unpack(model.pack())
    assert again.languages([t for _, t, _ in rows[:20]]) == model.languages([t for _, t, _ in rows[:20]])
    kept = langid.fit(df, 40, (19, 31))  # read from the shared folder
    assert kept.langs == model.langs and kept.languages([rows[0][1]]) == model.languages([rows[0][1]])


def test_confidence_is_calibrated():
    rows = documents(n=300)
    model = langid.Model([(lang, t) for _, t, lang in rows], {x: 75 for x in PHRASES}, (10, 12))
    rng = random.Random(3)
    tried = [(lang, " ".join(t.split("\n")[1].split()[: rng.randrange(1, 3)])) for _, t, lang in documents(seed=5, n=300)]
    win, n = langid.windows([t for _, t in tried])
    two = langid.np.sort(scores := model.sums(win, n), 1)[:, -2:]
    sure = model.sure(two[:, 1] - two[:, 0])
    right = [model.langs[k] == lang for k, (lang, _) in zip(scores.argmax(1), tried)]
    assert abs(float(sure.mean()) - sum(right) / len(right)) < 0.12 and (model.sure(langid.np.array([-3.0])) < 0.5).all()


def test_held_out_accuracy():
    rows = documents()
    model = langid.Model([(lang, t) for _, t, lang in rows], {x: 60 for x in PHRASES}, (19, 31))
    held_out = documents(seed=9, n=80)
    got = model.stretches([t for _, t, _ in held_out])
    right = sum({s[2] for s in runs} == {lang} for runs, (_, _, lang) in zip(got, held_out))
    assert right >= 76
