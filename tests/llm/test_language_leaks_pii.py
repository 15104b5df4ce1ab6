import random

import numpy as np
import pytest

from conftest import rows
from vocalith.llm import language, leaks, pii, pii_labelled, queries

# A line of each language to fit a small model on, and another to tell.
LINES = {
    "en": ["The van driver said that the lecture feed sounds muffled since the update", "Could we move the draft summary to the shelf near the loading dock"],
    "de": ["Ich glaube der Fahrer war heute früh neben der Laderampe und niemand hat es gemerkt", "Bitte richten Sie aus das Mikrofon kam sauber zurück"],
    "fr": ["Je crois que le chauffeur a laissé le brouillon au quatrième étage", "Nous ne savons pas encore pourquoi la bande est revenue propre"],
    "es": ["Creo que la nueva editora dejó la carpeta junto al muelle", "Todavía no sabemos por qué el albarán pasó del límite"],
    "ja": ["運転手さんによると納品書はもう一度処理が必要です", "どうして会議室のマイクが途中で切れましたのか分かりません"],
    "ko": ["우리 인턴 말로는 납품서 쪽이 먹먹하게 들려요", "왜 그런지 몰라도 왼쪽 채널만 중간에 끊겼어요"],
    "zh": ["我们还不知道为什么会议室的麦克风已经修好了", "夜班值班員說訓練資料還要再處理一遍"],
    "yue": ["我哋仲未知點解會議室嗰支咪仲要再做多次", "唔該你同後勤嗰邊講送貨單一直都冇上載"],
}


def model(spark):
    texts = [t for ts in LINES.values() for t in ts] * 3
    labels = [c for c, ts in LINES.items() for _ in ts] * 3
    return spark.sparkContext.broadcast(language.fit(texts, labels))


@pytest.mark.parametrize("label,code", [("en", "en"), (" EN ", "en"), ("en-GB", "en"), ("en_US", "en"), ("English", "en"), ("zh_Hans", "zh"), ("cmn", "zh"), ("zh-yue", "yue"), ("yue-HK", "yue"), ("jpn", "ja"), ("und", None), ("auto", None), ("", None), (None, None), ("n/a", None)])
def test_label_code(spark, label, code):
    df = spark.createDataFrame([(label,)], "v string")
    assert df.select(language.label_code(df.v)).first()[0] == code


DOCS = "doc_id long, text string, lang string, language string, kind string"


def test_documents_lines_and_labels(spark):
    mixed = "\n".join([LINES["en"][0], LINES["en"][1], "", "ok", LINES["ja"][1], '{"id":0,"start":1.5,"text":"' + LINES["en"][0] + '"}'])
    data = [(1, LINES["en"][1], "en-GB", "c", "c"), (2, LINES["de"][1], "en", None, None), (3, mixed, "en", None, None), (4, None, "en", None, None), (5, "", None, None, None), (6, "...", "xx", None, None), (7, "谢谢Quillan Haldwyke，我们还不知道为什么", None, None, None), (None, "x", None, None, None)]
    found = language.documents_languages(spark.createDataFrame(data, DOCS), model(spark))
    cases = rows(language.wrong_labels(found), "kind", "ref", "part_no", "language")
    assert cases == [("document", "2", -1, "de"), ("document", "7", -1, "zh"), ("line", "3", 0, "en"), ("line", "3", 1, "en"), ("line", "3", 4, "ja"), ("line", "3", 5, "en")]
    assert all(0 < r["confidence"] <= 1 for r in found.where("language is not null").collect())
    assert language.documents_languages(spark.createDataFrame([], DOCS), model(spark)).count() == 0


def test_short_lines_of_mixed_documents_come_out(spark):
    text = "\n".join([LINES["en"][0], LINES["en"][1], "", "ok", LINES["ja"][1], "..."])
    found = language.documents_languages(spark.createDataFrame([(1, text, "en", "c", "c")], DOCS), model(spark))
    lines = {r["part_no"]: r for r in found.where("kind = 'line'").collect()}
    assert sorted(lines) == [0, 1, 3, 4] and lines[3]["language"] == "en" and 0 < lines[3]["confidence"] < 0.1
    assert rows(language.wrong_labels(found), "part_no") == [(0,), (1,), (4,)]


def test_segments_once_each(spark):
    data = [("j", 0, LINES["ko"][0], "ja"), ("j", 0, LINES["ko"][0], "ja"), ("j", 1, LINES["yue"][1], "zh-yue"), ("j", 2, "um", "en"), ("j", 3, None, None), (None, 1, LINES["en"][0], None), ("j", 4, "[A] " + LINES["zh"][1] + "\n", None)]
    df = spark.createDataFrame(data, "job_id string, segment_index long, text string, language string")
    assert rows(language.wrong_labels(language.segment_languages(df, model(spark)))) == [("segment", "j", 0, "ko"), ("segment", "j", 4, "zh")]


def test_fit_undoes_wrong_labels():
    texts = [t for ts in LINES.values() for t in ts] * 12
    labels = [c for c, ts in LINES.items() for _ in ts] * 12
    r = random.Random(1)
    spoiled = [r.choice(language.CODES) if r.random() < 0.15 else c for c in labels]
    scores, _ = language.line_scores(texts, language.fit(texts, spoiled))
    assert np.mean([language.CODES[i] == c for i, c in zip(scores.argmax(1), labels)]) == 1


def test_held_out_accuracy_on_segments(spark, data):
    docs, segments = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/segment_records.parquet")
    weights = spark.sparkContext.broadcast(language.fit(*language.sample(docs, segments, 200)))
    got = language.segment_languages(segments, weights).where("language is not null and label is not null").collect()
    assert np.mean([r["language"] == r["label"] for r in got]) > 0.9  # what differs are wrong labels, about 6 %


def test_no_training_text():
    assert language.fit([], []).shape == (language.BUCKETS, len(language.CODES))


ITEM = "Nobody remembered who had first brought glass floats beneath the frozen waterfall, yet a retired cartographer borrowed them every spring. With 62 amber lanterns on the sledge, an elderly botanist set out and whistled."
HAN = "孩子们传说岛上的邮差曾在荒废的果园旁为一首歌数清了七十三个玻璃浮球没有谁记得最早是谁把木雕船桨带到寂静的磨坊前"
ITEMS = [(1, ITEM), (2, HAN), (3, None), (4, ""), (5, "short"), (1, ITEM)]


def words_changed(text, every):
    w = text.split()
    return " ".join("something" if i % every == every - 1 else x for i, x in enumerate(w))


PASSAGES = [
    (ITEM, [1]), (ITEM.upper(), [1]), (ITEM.replace(" ", "  ").replace(",", ""), [1]), ("Before it. " + ITEM[: len(ITEM) * 6 // 10] + " After it came.", [1]), (ITEM[: len(ITEM) * 4 // 10], []),
    (words_changed(ITEM, 12), [1]), (words_changed(ITEM, 4), []), (ITEM.replace(" who", " um, who").replace("frozen", "[00:01:02] frozen").replace("them", "them (coughs)"), [1]), ("A: " + ITEM.replace("brought ", "brought\nB: "), [1]),
    (HAN, [2]), (" ".join(HAN), [2]), (HAN[:20], []), (HAN.replace("岛上", "，岛嗯、上"), [2]), (ITEM + "\n" + HAN, [1, 2]), ("x" * 50_000 + " " + ITEM, [1]), ("", []), (None, []), ("plain words about nothing in particular", []),
]


def test_leaks(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(PASSAGES)] + [(None, ITEM, "x")], "doc_id long, text string, item_id string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = leaks.leaked(docs, items)
    assert rows(found, "doc_id", "item_id") == sorted((i, j) for i, (_, js) in enumerate(PASSAGES) for j in js)
    clean = {r["doc_id"]: r["text"] for r in leaks.without_leaks(docs, found).collect()}
    assert clean[3].startswith("Before it. ") and clean[3].endswith("After it came.") and "waterfall" not in clean[3]
    assert clean[17] == PASSAGES[17][0] and clean[16] is None and clean[0].strip(" .") == ""
    assert leaks.without_leaks(docs, found, whole=True).count() == docs.count() - found.select("doc_id").distinct().count()
    assert leaks.leaked(docs.where("false"), items).count() == 0 and leaks.leaked(docs, items.where("false")).count() == 0


def test_numbers_and_times_between_lines(spark):
    item = "雪橇上载着40件纸风筝退休的绘图师吹着口哨走向大理石桥上镇长许诺凡肯在白垩悬崖边上坐等的人都能领到6套琥珀灯笼"
    assert leaks.tokens("着40件 and 12 words")[0] == ["着", "4", "0", "件", "and", "12", "words"]
    docs = [(1, " ".join(item[:30])), (2, "00:20 - B: " + " ".join(ITEM.split()[:9]) + "\n00:27 - " + " ".join(ITEM.split()[9:20]) + "\n00:34 - " + " ".join(ITEM.split()[20:]))]
    found = leaks.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, ITEM)], "item_id long, text string"))
    assert rows(found, "doc_id", "item_id", "changed")[0][:2] == (1, 1) and rows(found, "doc_id", "item_id", "changed")[1] == (2, 2, 0.0)


def test_a_short_item_is_found_whole(spark):
    items = spark.createDataFrame([(1, "seven amber lanterns hung over the bridge"), (2, "two words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Then seven amber lanterns, um, hung over the bridge again."), (2, "two words"), (3, "amber lanterns hung elsewhere")], "doc_id long, text string")
    assert rows(leaks.leaked(docs, items), "doc_id", "item_id") == [(1, 1)]


KOREAN = "오래된 등대 지기 둘이 얼어 붙은 폭포 아래로 유리 부표 셋을 들고 갔다 그해 봄에 누가 먼저 왔는지 아무 도 몰랐다 은퇴한 지도 장이 썰매 위로 호박 등불 을 싣고 휘파람 불며 대리 석 다리 쪽에 섰다 했다 참".split()


def test_half_an_item_with_changes_and_fillers_is_found(spark):
    half = [w + " 음," if i in (4, 10, 16) else "다른" if i in (7, 14) else w for i, w in enumerate(KOREAN[: len(KOREAN) // 2 + 1])]
    han = HAN[:30]
    spoiled = " ".join(c + " 嗯，" if i % 10 == 4 else "另" if i in (9, 19, 28) else c for i, c in enumerate(han))
    docs = spark.createDataFrame([(1, " ".join(half)), (2, spoiled)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(KOREAN)), (2, HAN)], "item_id long, text string")
    assert rows(leaks.leaked(docs, items), "doc_id", "item_id") == [(1, 1), (2, 2)]


def test_every_copy_of_an_item_is_cut(spark, tmp_path):
    half = ITEM[: len(ITEM) * 6 // 10]
    docs = spark.createDataFrame([(1, f"Before. {ITEM} {ITEM} After."), (2, f"{HAN} {'plain words between. ' * 60}{HAN[:40]}"), (3, f"{half} and {half} and {half}")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, HAN)], "item_id long, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    clean = {r["doc_id"]: r["text"] for r in queries.p7_clean(spark, str(tmp_path)).collect()}
    assert not any(w in t for t in clean.values() for w in ("cartographer", "waterfall", "玻璃"))
    assert clean[1].startswith("Before. ") and clean[1].endswith(" After.") and clean[2].count("plain words between.") == 60
    assert rows(queries.p7_found(spark, str(tmp_path))) == [(1, 1), (2, 2), (3, 1)]


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PASSAGES)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = rows(leaks.leaked(docs, items))
    monkeypatch.setattr(leaks, "BLOCK_ITEMS", 1)
    assert rows(leaks.leaked(docs, items)) == whole


def test_chained_runs_measure_changes():
    item = [f"w{i}" for i in range(60)]
    r = random.Random(2)
    for _ in range(50):
        text, changes = [], 0
        for w in item:
            x = r.random()
            if x < 0.03:
                changes += 1
            elif x < 0.06:
                text.append("zz")
                changes += 1
            elif x < 0.09:
                text += [w, w]
                changes += 1
            else:
                text.append(w)
        known = leaks.Items([])
        for k in range(len(item) - leaks.WORDS + 1):
            known.at[tuple(item[k : k + leaks.WORDS])].append((0, k))
        hits = [(k, j) for k in range(len(text) - leaks.WORDS + 1) for _, j in known.at.get(tuple(text[k : k + leaks.WORDS]), ())]
        a, b, c, d, found = leaks.passage(item, text, hits)
        assert found <= changes and found == leaks._distance(item[a:b], text[c:d])


@pytest.fixture(scope="module")
def field():
    return pii.default_field()


def test_held_out_sentences(field):
    held = pii_labelled.expanded(3, seed=4321)
    texts, want = [t for t, _ in held], {(i, k, s) for i, (_, spans) in enumerate(held) for s, _, k in spans}
    got = {(d, k, s) for d, k, s, _ in pii.pieces(texts, field)}
    assert len(got & want) >= 0.985 * len(want) and len(got - want) <= 0.015 * len(want)


# None of these stands in the labelled table.
UNSEEN = {
    "latin": ["Mirelda Vellacrest", "Oswinne Quarrowby", "Thandor Druskine", "Zoltan Priestnall", "Wilhelmina Achterberg", "Siobhan McGillicuddy"], "han": ["鄢汐", "璩霁", "麴棠屿", "郜砚", "佘嶼", "闻澍"],
    "ja": ["霞堂 灯真", "朧谷 琴羽", "榎乃木 澪斗", "雪洞朔弥", "瀬織紗雪乃"], "ko": ["옹새결", "탁누림", "빙하율빛", "견라온슬"],
}
FRAMES = {
    "latin": ["My name is {}.", "Could you put me through to {} please?", "Mr {} asked for the transcript.", "Mein Name ist {}.", "Je m'appelle {}.", "Me llamo {}.", "A: this is {} speaking.", "The caller gave the name {} twice."],
    "han": ["我叫{}。", "请帮我转接{}先生。", "谢谢{}，这样就清楚了。", "来电人自称{}，说过两遍。"], "ja": ["私は{}と申します。", "{}さんにつないでください。", "録音機は{}が持って来ます。"], "ko": ["제 이름은 {}입니다.", "{} 님 바꿔 주세요."],
}


def test_names_that_training_never_saw(field):
    cases = [(f.format(n), f.index("{}"), n) for k, frames in FRAMES.items() for f in frames for n in UNSEEN[k]]
    assert not any(n in pii_labelled.SENTENCES or n.split()[-1] in pii_labelled.FAMILY for ns in UNSEEN.values() for n in ns)
    got = {(d, k, s, e) for d, k, s, e in pii.pieces([t for t, _, _ in cases], field)}
    want = {(i, "name", at, at + len(n)) for i, (_, at, n) in enumerate(cases)}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)


def test_no_stock_of_the_table_comes_from_the_corpus(spark, data):
    """Names and places that are exchanged are not those of the test corpus, so its figures are about unseen ones."""
    texts = [r[0] for r in spark.read.parquet(f"{data}/documents.parquet").where("text is not null").select("text").collect()]
    whole = " ".join(texts).lower()
    stock = [*pii_labelled.GIVEN, *[f.replace("_", " ") for f in pii_labelled.FAMILY], *pii_labelled.KANA_FAMILY, *pii_labelled.KANA_GIVEN, *pii_labelled.HANGUL_GIVEN]
    pieces = [x for k, x in pii_labelled.MARKUP.findall(pii_labelled.SENTENCES) if k == "name"]
    assert not [x for x in stock + pieces if x.lower() in whole]


def test_weights_are_stored_once(spark, tmp_path, monkeypatch, field):
    monkeypatch.setattr(pii, "default_field", lambda: field)
    first = pii.stored_field(spark, f"file://{tmp_path}/shared")
    monkeypatch.setattr(pii, "default_field", None)
    again = pii.stored_field(spark, f"file://{tmp_path}/shared")
    assert first is field and np.array_equal(again.weights, field.weights) and np.array_equal(again.moves, field.moves)


PIECES = [
    ("Send the summary to ketra.ashquill@heron.example. Thanks, Jorun Tarnfeld, that helps.", [("email", "ketra.ashquill@heron.example"), ("name", "Jorun Tarnfeld")]),
    ("Call me back on +1 (359) 555-0199 after six.", [("phone", "+1 (359) 555-0199")]),
    ("my number is three nine one five five five zero one eight three.", [("phone", "three nine one five five five zero one eight three")]),
    ("我叫鄢汐。我的电话是036 555 0127，请回电。", [("name", "鄢汐"), ("phone", "036 555 0127")]),
    ("录音笔请寄到青梧市石磬巷12号。", [("address", "青梧市石磬巷12号")]),
    ("ID on file: 000-02-0765.\nI live at Flat 1A, 84 Lantern Avenue, East Orrowby.", [("id_number", "000-02-0765"), ("address", "Flat 1A, 84 Lantern Avenue, East Orrowby")]),
    ("The storage quota got replaced. (ticket #6287-007) (model@rev29) 1234567890123", []), ("", []), (None, []), (" \n\n", []), ("a" * 30_000 + ". My name is Nerith Oldenmoor.", [("name", "Nerith Oldenmoor")]),
]


def test_mentions_and_placeholders(spark, field):
    df = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(PIECES)] + [(None, PIECES[0][0], "x")], "doc_id long, text string, kind string").repartition(2)
    got = rows(pii.mentions(df, field), "doc_id", "kind", "start_char")
    assert got == sorted((i, k, t.index(x)) for i, (t, xs) in enumerate(PIECES) for k, x in xs)
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(df, field).collect()}
    assert clean[0] == "Send the summary to [EMAIL]. Thanks, [NAME], that helps." and clean[8] is None and clean[7] == "" and clean[6] == PIECES[6][0]
    assert pii.mentions(df.where("false"), field).count() == 0


def test_the_gate_opens_for_a_piece_at_the_first_token():
    tokens = pii.Tokens(["Ann"])
    assert len(tokens.start) == 1
    weights, moves = np.zeros((pii.BUCKETS, pii.LABELS), np.float32), np.where(pii._ALLOWED, np.float32(0), np.float32(-1e9))
    moves[0, 0] = 1
    for f in tokens.features():
        weights[f[0], 1] += 0.5 / len(tokens.features())
    assert pii.Field(weights, moves).decode(tokens).tolist() == [1]


@pytest.mark.parametrize("text,good", [("seven three oh nine zero two", True), ("三七一九〇二", True), ("ゼロいちにさんよんご", True), ("QJ 12 three four five six", True), ("seven of the eight", False), ("AB 12345", False), ("123456", True)])
def test_an_id_may_be_spelled_out(text, good):
    assert pii._plausible("id_number", text) is good


def test_the_gate_changes_nothing(field):
    texts = [t for t, _ in pii_labelled.expanded(2, seed=77)]
    tokens = pii.Tokens(texts)
    emit = np.zeros((len(tokens.start), pii.LABELS), np.float32)
    for f in tokens.features():
        emit += field.weights[f]
    whole = np.zeros(len(emit), np.int8)
    for where, got in field._viterbi(emit, tokens.first, np.diff(np.r_[tokens.first, len(emit)])):
        whole[where] = got
    assert np.array_equal(whole, field.decode(tokens))


FILLED = {"en": " um,", "de": " ähm,", "fr": " euh,", "es": " eh,", "ko": " 음,", "zh": "，嗯，", "yue": "，呃，", "ja": "、えーと、"}


@pytest.mark.parametrize("step", [3, 4, 5])
def test_items_with_fillers_after_every_few_words_are_found(spark, data, step):
    """The first half, and the whole, of every real item with a filler after every few words: the scan loses none that the exact reading finds."""
    kept = [(r["item_id"], r["language"], r["text"]) for r in spark.read.parquet(f"{data}/eval_items.parquet").collect() if r["text"]]
    items = leaks.Items([(i, t) for i, _, t in kept])
    for i, language, text in kept:
        words, places = leaks.tokens(text)
        places.append(len(text))
        for n in (len(words), len(words) // 2 + 1):
            parts = [text[places[k] : places[k + 1]].rstrip() + (FILLED[language] if k % step == step - 1 else "") + ("" if language in ("zh", "yue", "ja") else " ") for k in range(n)]
            spoiled = "".join(parts)
            found = {row[0] for row in leaks.find(spoiled, items)}
            assert i in found or len(words) < 8, (i, spoiled)
            assert not found or [d for d, _, _ in items.candidates([leaks._bare(spoiled)])] == [0]


def test_the_part_of_a_text_that_is_read_gives_all_passages(spark, data):
    """What is found between the first and last window is what is found in whole texts, with numbers and Han at the edges of it."""
    kept = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/eval_items.parquet").collect() if r["text"]] + [(1, "着40件纸风筝退休的绘图师吹着口哨走向大理石桥上"), (2, "40 grey kites flew over the 12 marble bridges at dawn 99")]
    items = leaks.Items(kept)
    texts = [r[0] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect() if r[0]]
    texts += [f"件{kept[-2][1]}77", f"7 {kept[-2][1]}", f"{kept[-1][1]}件", f"件 {kept[-1][1]}", f"1234 {kept[-1][1]} 5678", f"{'before ' * 50}{kept[-1][1]}{' after' * 50} straße", kept[0][1], "ﬁne " + kept[-1][1], ""]
    bare = [leaks._bare(t) for t in texts]
    got = {d: sorted(leaks._found(*leaks._tokens(bare[d], low, high), items, 0.5, 0.1)) for d, low, high in items.candidates(bare)}
    for d, t in enumerate(texts):
        assert got.get(d, []) == leaks.find(t, items), t


def test_windows_hash_as_the_tokens_read(spark, data):
    """Every text's windows of tokens by the numpy scan are those of the plain reading."""
    texts = [r[0] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect() if r[0]]
    texts += ["", " ", "A1 B2", "着40件 and 12 words 3 4 555", "12件34", "ａｂｃ ＡＢＣ１２ x", "a_b c_d e_f g_h", "漢字々〇 12 語", "İx y z w"]
    odd = leaks._chars()[3]
    for t in texts:
        bare = leaks._bare(t).replace("\x01", " ").replace("ß", "ss")
        if odd[np.frombuffer(bare.encode("utf-32-le", "surrogatepass"), np.uint32)].any():
            continue
        words = leaks.tokens(t)[0]
        got = leaks._windows(bare)[0].tolist()
        want = [tuple(words[k : k + leaks.WORDS]) for k in range(len(words) - leaks.WORDS + 1)]
        assert len(got) == len(want)
        assert len(set(zip(want, got))) == len(set(want)) == len(set(got))
