import random
from collections import Counter

from quire.llm import language, mojibake, ocr, skipgram

RECORD = "table_name string, record_id string, content string, n long"
FR = "L’autorité de contrôle a approuvé la méthode. La société mère a différé l’été à Genève, où l’hôtel était fermé."
RU = "Отдел закупок завершил инвентаризацию запасов. Комитет изучил резерв по сомнительным долгам."
EN = "The auditor’s note says “pending” – see clause §7. Costs were €4,210 and 31°C ± 2."
GARBLED = {
    "u1252": lambda s: s.encode().decode("cp1252", "replace").replace("�", ""), "latin": lambda s: s.encode().decode("latin-1"), "dos": lambda s: s.encode().decode("cp437"), "mac": lambda s: s.encode().decode("mac-roman"), "twice": lambda s: s.encode().decode("latin-1").encode().decode("latin-1"), "cyr": lambda s: s.encode("cp1252").decode("cp1251"),
}


def records(spark):
    clean = [("c", f"clean{i}", t, 1) for i in range(120) for t in [[FR, RU, EN, "ÂGE MOYEN, PROVISÃO and AÑO are headings.", "The √n index and the Ô-test. ├ a; └ b", "plain", None, ""][i % 8]]]
    bad = [("c", f"{k}_{n}", f"plain line\n{f(t)}", 1) for k, f in GARBLED.items() for n, t in (("fr", FR), ("en", EN)) if not (k == "cyr" and n == "en")]
    bad += [("c", "koi", RU.encode("koi8-r").decode("cp1251"), 1), ("c", "lost", "l’autorité ��� de contr��le", 1)]
    return spark.createDataFrame(clean + bad + bad[:2], RECORD), {r[1] for r in bad}


def test_garbled_records_and_only_those(spark):
    df, bad = records(spark)
    got = {r.record_id: r for r in mojibake.garbled(df.repartition(3)).collect()}
    assert set(got) == bad
    for k in ("latin", "dos", "mac", "twice"):
        assert got[f"{k}_fr"].restored == f"plain line\n{FR}" and got[f"{k}_en"].restored == f"plain line\n{EN}"
    assert got["cyr_fr"].restored == f"plain line\n{FR}" and got["koi"].restored == RU
    assert not got["lost"].complete and got["koi"].complete
    assert mojibake.garbled(df.limit(0)).count() == 0


def test_characters_lost_to_question_marks(spark):
    ask = "Was this page helpful? Rate it from 1 to 5. Why? See page 3?"
    clean = [("c", f"clean{i}", t, 1) for i in range(160) for t in [[FR, RU, EN, ask][i % 4]]]
    bad = [("c", "fr", FR.encode("ascii", "replace").decode(), 1), ("c", "line", f"plain line\n{ask}\nL’h?tel ?tait ferm?, la soci?t? a approuv? la m?thode.", 1)]
    got = {r.record_id: r for r in mojibake.garbled(spark.createDataFrame(clean + bad, RECORD).repartition(3)).collect()}
    assert set(got) == {"fr", "line"} and got["fr"].restored == bad[0][2] and not got["fr"].complete and got["fr"].encodings == "lost"


def test_spans_within_a_line(spark):
    """Characters are labelled: two spans of one line, garbled in different ways, are each read again, and what is between them stays."""
    good = "La société mère a différé l’été"
    mixed = f"{good.encode().decode('latin-1')} and plain words until {'Отдел закупок завершил инвентаризацию'.encode('koi8-r').decode('cp1251')}"
    clean = [("c", f"clean{i}", t, 1) for i in range(160) for t in [[FR, RU, EN, "plain words"][i % 4]]]
    got = {r.record_id: r for r in mojibake.garbled(spark.createDataFrame([*clean, ("c", "m", mixed, 1)], RECORD)).collect()}
    assert set(got) == {"m"} and got["m"].restored == f"{good} and plain words until Отдел закупок завершил инвентаризацию"


def test_inverse():
    for pair in mojibake.PAIRS:
        t = "Отчёт" if pair[0] in ("cp1251", "koi8-r", "cp866") else "été"
        try:
            g = t
            for _ in range(pair[2]):
                g = g.encode(pair[0]).decode(pair[1])
        except UnicodeError:
            continue
        assert mojibake.inverse(g, pair) == t or g == t
    assert mojibake.inverse("ÂGE", ("utf-8", "cp1252", 1)) is None


S = {
    "en": ["The audit committee recorded the deposit insurance premium before the reporting date", "In addition, the survey team completed the maintenance contract without a qualified opinion", "Over the medium term, the grain mill postponed the training budget subject to available funding"],
    "fr": ["La direction générale a rejeté la politique de dividende malgré plusieurs rappels", "En outre, le comité d’audit a certifié le budget de formation sous la tutelle du ministère", "Le fonds de pension a reporté les prévisions de trésorerie avant la date de clôture"],
    "de": ["Die Geschäftsführung begründete die Netzverluste zum dritten Mal in Folge", "Im Berichtsjahr prüfte der Vorstand das Arzneimittelregister mangels schriftlicher Belege", "Auf Wunsch der Gläubiger kürzte die Sparkasse die langfristigen Verbindlichkeiten"],
    "ru": ["Отдел закупок завершил инвентаризацию запасов несмотря на рост затрат", "Комитет по аудиту изучил резерв по сомнительным долгам", "Надзорный орган утвердил бюджет на обучение после выезда на место"],
}
DOC = "doc_id long, text string, lang string, run int"


def documents(spark):
    r, rows = random.Random(2), []
    for i in range(240):
        lang = r.choice(list(S))
        rows.append((i, ". ".join(r.choice(S[lang]) for _ in range(4)) + ".", lang, 0))
    j = lambda lang: ". ".join(S[lang]) + "."
    rows += [
        (1001, j("de"), "fr", 0), (1002, j("en"), None, 0), (1003, f"{j('en')}\n{j('fr')}", "en", 0), (1004, j("ru"), "Russian", 0), (1005, j("fr"), "fr-FR", 0), (1006, j("de"), "und", 0), (1007, None, None, 0), (1008, "", None, 0), (1009, " 12 — 7 ", None, 0),
        (1010, f"{S['en'][0]}. {S['fr'][0]}. {S['en'][1]}. {S['en'][2]}.", "EN", 0), (1011, S["fr"][1] + ".", "xx", 0), (1012, j("en"), "GERMAN", 0),
    ]
    return spark.createDataFrame(rows, DOC)


def test_wrong_labels(spark, rows):
    got = [x for x in rows(language.wrong_labels(documents(spark))) if x[0] > 1000]
    assert got == [(1001, "de"), (1002, "en"), (1003, "en"), (1003, "fr"), (1006, "de"), (1011, "fr"), (1012, "en")]


def test_segments_and_accuracy(spark):
    d = documents(spark)
    s = language.segments(d).collect()
    of = {}
    for r in s:
        of.setdefault(r.doc_id, []).append(r)
    assert [(r.lang, r.first_sentence, r.n_sentences) for r in sorted(of[1003], key=lambda r: r.first_sentence)] == [("en", 0, 3), ("fr", 3, 3)]
    assert all(0 <= r.confidence <= 1 for r in s) and not {1007, 1008, 1009} & set(of)
    right = [len(of[r.doc_id]) == 1 and of[r.doc_id][0].lang == r.lang for r in d.where("doc_id < 1000").collect()]
    assert sum(right) >= 0.99 * len(right)
    assert language.wrong_labels(d.limit(0)).count() == 0


def page_reader(extra=()):
    words = Counter({w: 500 for w in "the of and in audit report annual board minutes examined committee capital payment auditor works handled moderate delay five year pre post tax margin stock reported for".split()} | dict(extra))
    return ocr.Reader(dict(words), {}, {"group", "holding", "sc"}, {"annual", "report", "board", "minutes"})


def test_page_numbers_and_headers():
    for t in ("3 |", "p. 1", "1", "- 3 -", "Page I of 7", "(1)", "[3]", "— 2 —", "~ l ~", "Seite 2", "3-12", "b / 9", "PAGE 4", "Pagc 3", "Uk. 9 of 12"):
        assert ocr.page_number(t, True), t
        assert not ocr.page_number(t, False)
    for t in ("2019", "for Q2 2017.", "--- | --- | ---", "", "12 km", "the", "9.", "5,032,506."):
        assert not ocr.page_number(t, True), t
    forms = {"group", "holding", "sc"}
    for t in ("SAHAR ZEJER BANK GROUP", "Annual Report 2017   LEPEL MOZAN HOLDING", "Lepel Mozan Group – Audit Report 2018", "Audit Rep0rt 2O18 | Lepel Mozan S.C.", "Gezar Logistics Group: Board Minutes 2019"):
        assert ocr.header(t, None, forms), t
    for t in ("ALL RIGHTS RESERVED; NO PART", "Measure | FY2018 | FY2017", "DOWNLOADED ON 2020-01-01 AT 10:22 BY READER NO. 12345", "The audit committee", "THE GRAIN MILL SUMMARISED THE COUNT."):
        assert not ocr.header(t, None, forms), t


def test_reading_of_a_page():
    lines = ["TAPOL ROZAM GROUP", "The audit committee cxamined the pa-", "3 |", "yment of c@pital in 2O20, the five-", "year works and pre-", "and post-tax margin with a moderate de¬", "lay for the auditor."]
    noise, text = page_reader().read(lines, [None] * len(lines))
    assert noise == [{"header"}, {"hyphenation", "characters"}, {"page_number"}, {"characters", "hyphenation"}, set(), {"hyphenation"}, set()]
    assert text == ["The audit committee examined the payment of capital in 2020, the five-year works and pre- and post-tax margin with a moderate delay for the auditor."]
    assert page_reader().read([], []) == ([], []) and page_reader().read([""], [None])[0] == [set()]


def test_noise_of_tables(spark, rows):
    good = "The audit committee examined the payment of capital for the moderate delay."
    c = [(f"d_{i}", "d", good, "clash") for i in range(150)] + [("d_x", "d", "The audif committee examined the pay­\nment of capital.", "c"), ("e_1", "e", "The audif comm-\nittee", "c"), ("d_n", "d", None, "c")]
    b = [(f"b{i}", "d", 1, i, t, 100.0 * i, 800.0, "c") for i, t in enumerate(["TAPOL ROZAM GROUP", good, "The committee ex-", "amined the capital", None])] + [("b9", "d", 1, 9, "p. 1", 790.0, 800.0, "c"), ("b10", "d", 2, 1, "1", 790.0, None, "c")]
    cd = spark.createDataFrame(c + c[-3:], "chunk_id string, document_id string, content string, unit string")
    pd_ = spark.createDataFrame([("d", "scanned_image"), ("d", "scanned_image"), ("e", "mixed")], "document_id string, origin_type string")
    bd = spark.createDataFrame(b + b[:2], "box_id string, document_id string, page_number int, idx int, text string, y1 double, page_height double, unit string")
    got = rows(ocr.noise(cd, pd_, bd))
    assert got == [("chunks", "d_x", "characters"), ("chunks", "d_x", "hyphenation"), ("ocr_boxes", "b0", "header"), ("ocr_boxes", "b2", "hyphenation"), ("ocr_boxes", "b9", "page_number")]
    fixed = {r.unit: r.text for r in ocr.repaired(cd, pd_, bd).collect()}
    assert fixed["d_x"] == "The audit committee examined the payment of capital." and "e_1" not in fixed
    assert ocr.noise(cd.limit(0), pd_.limit(0), bd.limit(0)).count() == 0


def test_skip_gram_puts_words_of_one_context_together(spark):
    r = random.Random(1)
    lines = [[f"the {r.choice(['cat', 'dog'])} eats {r.choice(['meat', 'fish'])} at home while a {r.choice(['car', 'truck'])} drives down roads"] for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in lines], "lines array<string>")
    n = Counter(w for x in lines for w in ocr.words_of(x))
    v = skipgram.train(df, list(n.items()), ocr.words_of)
    near = lambda a, b: float(v[a] @ v[b])
    assert near("cat", "dog") > near("cat", "truck") and near("car", "truck") > near("car", "fish")
    assert skipgram.train(df.limit(0), [], ocr.words_of) == {}
