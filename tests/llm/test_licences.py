import re

from hookloom.llm import licences
from tests.llm.edges import documents, no_documents, prose

TEXTS = [
    "Released under the MIT License.", prose(1, 50) + "\nLicensed under the Apache License, Version 2.0.\n" + prose(2, 30),
    "// " + licences.TEMPLATES["mit"].replace("Software", "software").replace(". ", ".\n// "),
    "intro\n\n" + licences.TEMPLATES["apache-2.0-header"].replace(", ", ",\n# ") + "\n \nmore text",
    "licensed, under: CC-BY nc 4.0", "released under the licence of mit", "Licensed under CC BY 4.0.\nLicensed under CC BY-NC 4.0.",
    licences.TEMPLATES["isc"] * 2, "mit license " * 40, prose(3, 400),
    "My notes. " + prose(9, 30) + "\n\n" + licences.TEMPLATES["mit"].replace("following conditions: ", "following conditions:\n\n").replace(
        "Software. THE", "Software.\n\nTHE") + "\n\n" + prose(10, 60),
    prose(11, 200) + " " + licences.TEMPLATES["mit"] + " " + prose(12, 150), prose(13, 12) + " This work is licensed under the MIT License, " + prose(14, 9),
]


def brute(text, threshold=0.8):
    plain = re.sub(r"[^\w\n]+|_", " ", (text or "").lower())
    parts = {plain, *re.split(r"\n ?\n", plain), *plain.split("\n")}
    found = {}
    every = plain.split()
    windows = []
    for name, wording in licences.TEMPLATES.items():
        plain_words = licences.plain_template(wording).split()
        grams = set(zip(plain_words, plain_words[1:]))
        windows += [(name, every[at:at + len(plain_words)]) for at, pair in enumerate(zip(every, every[1:])) if pair in grams]
    for only, words in [*((None, part.split()) for part in parts), *windows]:
        own = set(zip(words, words[1:]))
        for name, wording in licences.TEMPLATES.items():
            if only not in (None, name):
                continue
            plain_words = licences.plain_template(wording).split()
            grams = set(zip(plain_words, plain_words[1:]))
            if own and 2 * len(own & grams) / (len(own) + len(grams)) >= threshold:
                found[name] = max(found.get(name, 0), 2 * len(own & grams) / (len(own) + len(grams)))
    return found


def test_licences_match_brute_force(spark):
    docs = documents(spark, *TEXTS)
    got = sorted((tuple(r) for r in licences.licence_report(docs).collect()), key=repr)
    want = []
    for row in docs.collect():
        found = brute(row["text"])
        want.append((row["doc_id"], len(found), ",".join(sorted(found)), round(max(found.values()), 6) if found else None))
    assert got == sorted(want, key=repr)
    assert sum(bool(r[1]) for r in got) >= 9
    by_text = {r["doc_id"]: r["text"] for r in docs.collect()}
    licence_of = {by_text[r[0]]: r[2] for r in got if r[0]}
    # In three paragraphs of a longer text, inside one paragraph, and in the middle of a line.
    assert [licence_of[text].split(",")[0] for text in TEXTS[-3:]] == ["mit", "mit", "mit-notice-licensed"]


def test_empty_table_and_plan(spark):
    assert licences.licence_report(no_documents(spark)).collect() == []
    plan = licences.licence_report(documents(spark, "a b"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_bounds_hold_for_low_thresholds(spark):
    """A long part that shares little with a template still counts when the threshold is low."""
    words = licences.plain_template(licences.TEMPLATES["mpl-2.0-header"]).split()
    own = len(set(zip(words, words[1:])))
    # As many other words as leave a Dice coefficient of just over one half.
    text = " ".join(words + [f"w{i}" for i in range(int(1.6 * own))])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = licences.find_licences(docs, ["doc_id"], threshold=0.5).first()["found"]
    want = {name: round(dice, 9) for name, dice in brute(text, 0.5).items()}
    assert {f.licence: round(f.dice, 9) for f in found} == want and "mpl-2.0-header" in want


def test_too_few_bigrams_are_left_without_the_needed_words():
    for wording in licences.TEMPLATES.values():
        words = licences.plain_template(wording).split()
        grams = set(zip(words, words[1:]))
        for threshold in (0.5, 0.8, 1.0):
            needed = licences.needed_words(" ".join(words), threshold)
            left = [pair for pair in grams if needed.isdisjoint(pair)]
            # As many common bigrams as there are left do not reach the threshold.
            assert 2 * len(left) / (len(left) + len(grams)) < threshold


def test_texts_without_needed_words_are_not_cut_into_bigrams(spark):
    texts = ["the MIT.", "Mit", "_mit_", "commit mitten", "permit 1mit mit1", None, "é mit", "émit mité"]
    table = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "i int, text string")
    found = table.select("i", licences.holds_any(table["text"], {"mit", "apache"}).alias("may")).collect()
    # A letter beyond ASCII beside a word may let a text through, never keep one out.
    assert [row["i"] for row in found if row["may"]] == [0, 1, 2, 6, 7]
