import time
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from cohortloom.llm import fertility, langid, packing
from cohortloom.llm.vocab import default_path, json_model, piece_model

from .conftest import order

SPACE = " \t\n\r\x0b\x0c"


def base_measures(text):
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
    return (
        len(words), sum(c not in SPACE for c in text), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed,
    )


def test_base_measures_match_brute_force(documents, rows):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    found = fertility.quality_measures(documents).select(*names).collect()
    assert order(found) == order((i, *base_measures(t)) for i, t in rows)


def test_token_measures_match_brute_force(documents, rows):
    model = piece_model(default_path("piece_bpe_32k.model"))
    found = {(r["doc_id"], r["n_words"]): r for r in fertility.quality_measures(documents).collect()}
    for doc_id, text in rows[:60]:
        words = (text or "").encode().split()
        ids = [i for w in words for i in model.encode(w.decode())]
        row = found[doc_id, len(words)]
        assert row["n_tokens"] == len(ids)
        if ids:
            share = np.array(list(Counter(ids).values())) / len(ids)
            assert abs(row["token_entropy"] + (share * np.log2(share)).sum()) < 1e-9
            assert abs(row["byte_share"] - sum(model.is_byte(i) for i in ids) / len(ids)) < 1e-12
        else:
            assert row["token_entropy"] is None


def test_bands_reject_what_no_writer_makes(spark):
    rng = np.random.default_rng(1)
    prose = "The committee met on Monday, and several members asked why the plan had changed since the spring."
    blob = " ".join("".join(chr(c) for c in rng.integers(0x10300, 0x10340, 9)) for _ in range(40))
    digits = " ".join("".join(map(str, rng.integers(0, 10, 60))) for _ in range(20))
    docs = spark.createDataFrame([(1, prose * 3, "en"), (2, blob, "en"), (3, digits, "en"), (4, prose, "fr")], "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r for r in fertility.quality_measures(docs).collect()}
    assert kept[4]["kept"] and not kept[4]["base_failed"]
    assert not kept[2]["kept"] or not kept[3]["kept"]
    assert fertility.keep_good(docs).columns == docs.columns
    strict = {"fr": fertility.Band((9.0, 12.0), 0.0, 0.0)}
    judged = {r["doc_id"]: r["rejected_by"] for r in fertility.quality_measures(docs, bands=fertility.BANDS | strict).collect()}
    assert judged[4] == "chars_per_token"


CLEAN = {
    ("ka", "other"): "ქართული ენა არის საქართველოს სახელმწიფო ენა და მას მილიონობით ადამიანი ლაპარაკობს მთელ მსოფლიოში ყოველდღე",
    ("am", "other"): "አማርኛ የኢትዮጵያ የሥራ ቋንቋ ሲሆን ብዙ ሰዎች በየቀኑ ይናገሩታል እንዲሁም ይጽፉታል በትምህርት ቤት ይማሩታል",
    ("my", "other"): "မြန်မာ ဘာသာ စကား သည် မြန်မာ နိုင်ငံ ၏ ရုံးသုံး ဘာသာ ဖြစ်ပြီး လူ အများ ပြော ဆို ကြသည်",
    ("km", "other"): "ភាសា ខ្មែរ គឺជា ភាសា ផ្លូវការ របស់ ប្រទេស កម្ពុជា ហើយ មនុស្ស ជាច្រើន និយាយ វា រាល់ថ្ងៃ",
    ("hy", "other"): "Հայերենը Հայաստանի պետական լեզուն է և այն խոսում են միլիոնավոր մարդիկ ամբողջ աշխարհում ամեն օր",
    ("chr", "other"): "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ ᎠᏂᏴᏫᏯ ᎤᎾᏤᎵ ᎦᏬᏂᎯᏍᏗ ᎨᏒᎢ ᎠᎴ ᎤᏂᏣᏘ ᎠᏂᏬᏂᏍᎬ ᎪᎯ ᎢᎦ",
    ("dv", "other"): "ދިވެހި ބަހަކީ ދިވެހިރާއްޖޭގެ ރަސްމީ ބަހެވެ އަދި އެއީ ގިނަ ބަޔަކު ވާހަކަ ދައްކާ ބަހެކެވެ މިއަދު ވެސް",
    ("ff", "other"): "𞤆𞤵𞤤𞤢𞤪 𞤫𞤲 𞤲𞤺𞤮𞤲𞤭 𞤯𞤫𞤥𞤺𞤢𞤤 𞤢𞤬𞤪𞤭𞤳 𞤸𞤭𞥅𞤪𞤲𞤢𞥄𞤲𞤺𞤫 𞤱𞤮𞤲𞤣𞤫 𞤫 𞤧𞤢𞤲𞤼𞤪𞤢𞤤 𞤥𞤢𞤧𞤭𞤲",
    ("th", "indic"): "ภาษา ไทย เป็น ภาษา ราชการ ของ ประเทศ ไทย และ มี ผู้พูด หลาย ล้าน คน",
    ("si", "indic"): "සිංහල භාෂාව ශ්‍රී ලංකාවේ රාජ්‍ය භාෂාවක් වන අතර බොහෝ දෙනා එය දිනපතා කතා කරති",
    ("gu", "indic"): "ગુજરાતી ભાષા ભારત દેશના ગુજરાત રાજ્યની મુખ્ય ભાષા છે અને ઘણા લોકો તે બોલે છે",
    ("ko", "cjk"): "한국어는 많은 사람들이 매일 쓰는 말이며 학교와 집에서 아이들이 배우고 읽고 쓰는 언어이다",
    ("el", "greek"): "Η ελληνική γλώσσα είναι μία από τις αρχαιότερες γλώσσες του κόσμου και μιλιέται σήμερα από πολλούς",
    ("ru", "cyrillic"): "Комитет собрался в понедельник и несколько членов спросили почему план изменился с прошлой весны",
    ("he", "hebrew"): "הוועדה נפגשה ביום שני וכמה חברים שאלו מדוע התוכנית השתנתה מאז האביב שעבר",
    ("ar", "arabic"): "اجتمعت اللجنة يوم الاثنين وسأل العديد من الأعضاء لماذا تغيرت الخطة منذ الربيع الماضي",
    ("vi", "latin"): "Ủy ban đã họp vào thứ Hai và một số thành viên hỏi tại sao kế hoạch đã thay đổi kể từ mùa xuân",
    ("en", "latin"): "The committee met on Monday and several members asked why the plan had changed since the spring",
}


def test_clean_text_of_each_script_stays(spark):
    named = [(i, text, lang) for i, ((lang, _), text) in enumerate(CLEAN.items())]
    unnamed = [(100 + i, text, "en") for i, text, lang in named if lang != "vi"]  # a wrong language does not reject either
    docs = spark.createDataFrame(named + unnamed, "doc_id long, text string, lang string")
    found = {r["doc_id"]: (r["script"], r["rejected_by"]) for r in fertility.quality_measures(docs).collect()}
    for i, (_, script) in enumerate(CLEAN):
        assert found[i] == (script, None) and found.get(100 + i, found[i]) == found[i], named[i][2]


def test_rules_keep_rows_and_columns(documents, empty):
    kept = fertility.keep_good(documents)
    assert kept.schema == documents.schema
    assert kept.count() == fertility.quality_measures(documents).where("kept").count() > 100
    assert fertility.quality_measures(empty).count() == 0


def test_packing_covers_every_id_once(documents, rows):
    pieces = packing.pack(documents).collect()
    model = json_model(default_path("word_bpe_49k.json"))
    wanted = Counter()
    for doc_id, text in rows:
        ids = model.encode(text or "", add_special_tokens=False).ids + [2]
        wanted[doc_id, zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"] and p["length"] > 0
        by_doc[p["doc_id"], p["doc_tokens"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    got = Counter()
    for (doc_id, n), own in by_doc.items():
        copies = sum(p["length"] for p in own) // n
        own = sorted(own, key=lambda p: p["start"])
        if copies == 1:
            assert [p["start"] for p in own] == np.cumsum([0, *[p["length"] for p in own]])[:-1].tolist()
            got[doc_id, zlib.crc32(b"".join(p["ids"] for p in own)), n] += 1
        else:  # repeated rows: every id as often as there are rows
            at = np.zeros(n, int)
            for p in own:
                at[p["start"] : p["start"] + p["length"]] += 1
            assert set(at) == {copies}
    assert all(wanted[k] == v for k, v in got.items()) and len(got) >= len(rows) - 10
    padding = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == np.cumsum([0, *[p["length"] for p in own]])[:-1].tolist()
        total = sum(p["length"] for p in own)
        assert total <= 4096 and len(own) <= packing.Limits().segments
        padding += 4096 - total
    assert padding <= 4096 * 3  # at most the last sequence of each task


def test_packing_limits_and_prompts(spark):
    docs = spark.createDataFrame([(i, "word " * (5 + i % 40), i % 7) for i in range(400)], "doc_id long, text string, asked long").coalesce(1)
    limits = packing.Limits(tokens=64, segments=3, loss_tokens=50)
    found = packing.pack(docs, limits, prompt_tokens="asked", cut=False).collect()
    sums = defaultdict(lambda: [0, 0, 0])
    for p in found:
        sums[p["sequence_id"]][0] += p["length"]
        sums[p["sequence_id"]][1] += 1
        sums[p["sequence_id"]][2] += p["loss_tokens"]
    assert all(a <= 64 and b <= 3 and c <= 50 for a, b, c in sums.values())
    assert len(found) == 400 and sum(p["loss_tokens"] for p in found) == sum(6 + i % 40 - i % 7 for i in range(400))
    assert packing.pack(docs.where("false")).count() == 0


def test_packing_is_linear_in_the_length_of_a_text():
    seconds = []
    for millions in (1, 8):
        ids, loss = np.arange(millions * 1_000_000, dtype="<u4"), np.ones(millions * 1_000_000, np.bool_)
        loss[::3] = False
        packer, begin = packing.Packer(packing.Limits(loss_tokens=2000), 0), time.perf_counter()
        pieces = [*packer.add([1], [ids], [loss]), *packer.finish()]
        seconds.append(time.perf_counter() - begin)
        assert np.array_equal(np.concatenate([p[2] for p in pieces]), ids)
        assert all(p[3] == loss[p[1] : p[1] + len(p[2])].sum() <= 2000 for p in pieces)
    assert seconds[1] < 2


def test_waiting_texts_are_bounded_by_tokens():
    packer, held = packing.Packer(packing.Limits(), 0, pool_tokens=50_000), []
    for i in range(300):
        ids = np.full(9_000, i, "<u4")
        for _ in packer.add([i], [ids], [np.ones(9_000, np.bool_)]):
            held.append(sum(map(len, packer.ids)))
    assert max(held) <= 2 * 59_000 and packer.size.sum() <= 50_000
    assert sum(len(p[2]) for p in packer.finish()) < 60_000


def test_language_of_held_out_texts(documents, empty):
    held_out = langid.id_fold(3) == F.lit(1)
    model = langid.train(documents, ~held_out)
    found = langid.predict(documents, model, held_out)
    joined = found.join(documents.select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null and length(text) > 40")
    assert joined.where("lang = lang_pred").count() >= 0.95 * joined.count() > 0
    undecided = {r["doc_id"]: r for r in found.where("doc_id >= 900001").collect()}
    assert all(undecided[i]["lang_pred"] == "und" and undecided[i]["score"] == 0 for i in (900001, 900002, 900003))
    assert undecided[900007]["lang_pred"] != "und"
    assert found.where("score < 0 or score > 1").count() == 0 and found.count() == documents.count()
    assert {r[0] for r in langid.predict(documents, langid.train(empty, F.lit(True)), held_out).select("lang_pred").distinct().collect()} == {"und"}


def test_language_scores_match_direct_sums(documents):
    model = langid.train(documents, F.lit(True), buckets=1 << 10)
    from cohortloom.llm.words import slices
    import pyarrow as pa

    texts = ["Ab c", "zz", "q"]
    part = next(slices(pa.array(texts)))
    best, share = model.predict(part)
    for i, text in enumerate(texts):
        alone = next(slices(pa.array([text])))
        b, s = model.predict(alone)
        assert b[0] == best[i] and abs(s[0] - share[i]) < 1e-9


def test_languages_of_one_script_are_told_apart(spark):
    """Russian and Ukrainian, Hindi and Marathi: the letters are shared, the runs of them are not."""
    words = {
        "ru": "и что это как его но они был только она мы вы если когда большой город человек время который сказал только первый".split(),
        "uk": "і що це як його але вони був тільки вона ми ви якщо коли велике місто людина час який сказав лише перший".split(),
        "hi": "और यह वह नहीं है था के लिए में से को कर रहा हूँ बड़ा शहर आदमी समय जो कहा केवल पहला".split(),
        "mr": "आणि हा तो नाही आहे होता साठी मध्ये पासून ला करत आहे मोठे शहर माणूस वेळ जो म्हणाला फक्त पहिला".split(),
    }
    rng = np.random.default_rng(2)
    rows = []
    for i in range(800):
        lang = list(words)[i % 4]
        text = " ".join(words[lang][j] for j in rng.integers(0, len(words[lang]), 8))
        rows.append((i, text.upper() if i % 5 == 0 else text, lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({n: F.lit("x") for n in ("held_out", "lang_pred", "score", "bucket")})
    held_out = langid.id_fold(3) == F.lit(1)
    found = {r["doc_id"]: r for r in langid.predict(docs, langid.train(docs, ~held_out), held_out).where("held_out").collect()}
    assert len(found) > 200 and np.mean([found[i]["lang_pred"] == lang for i, _, lang in rows if i in found]) >= 0.98


def test_language_ties_and_long_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "abc abc", "zz"), (2, "abc abc", "aa"), (3, "abc", None)], "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True))
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(docs, model, F.lit(False)).collect()} == {("aa", 0.5)}
    from cohortloom.llm.words import slices
    import pyarrow as pa

    part = next(slices(pa.array(["ÉTÉ à la plage, \U0001f642 СЛОВО " * 300, "", "été"])))
    whole = [np.concatenate(x) for x in zip(*langid._features(part, 1 << 12), strict=True)]
    monkeypatch.setattr(langid, "_BLOCK", 7)
    blocks = [np.concatenate(x) for x in zip(*langid._features(part, 1 << 12), strict=True)]
    assert Counter(zip(*map(np.ndarray.tolist, whole), strict=True)) == Counter(zip(*map(np.ndarray.tolist, blocks), strict=True))
    text = str(part.text(0), "utf-8").lower()
    assert (whole[1] == 0).sum() == sum(len(text) - n + 1 for n in langid.ORDERS)
