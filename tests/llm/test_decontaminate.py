import hashlib
import random
import re

from hookloom.llm import decontaminate
from tests.llm.edges import documents, no_documents, prose, rows_of

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORDS.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        words = words_of(text)
        if words:
            size = min(13, len(words))
            for at in range(len(words) - size + 1):
                windows.setdefault(tuple(words[at:at + size]), set()).add("" if item is None else str(item))
    rows = []
    for doc_id, text in docs:
        words, hit, found = words_of(text), set(), set()
        for size in {len(w) for w in windows}:
            for at in range(len(words) - size + 1):
                items_here = windows.get(tuple(words[at:at + size]))
                if items_here:
                    found |= items_here
                    hit.update(range(at, at + size))
        rows.append((
            doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
            len(hit) > 0 and 20 * len(hit) >= len(words),
        ))
    return sorted(rows, key=repr)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, extra string")


def check(spark, texts, items):
    docs = documents(spark, *texts)
    got = rows_of(decontaminate.contamination_report(docs, bench(spark, [(*i, "x") for i in items])))
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], items)


def test_passages_windows_and_short_items(spark):
    item = prose(50, 40)
    words = item.split()
    texts = [
        item, prose(51, 80) + " " + item + ". " + prose(52, 80), " ".join(words[5:18]), " ".join(words[5:17]),
        item.upper().replace(" ", ", "), " ".join(words[:20]) + " " + " ".join(words[20:][::-1]), item + " " + item,
        prose(53, 3000) + " " + " ".join(words[3:16]), "alpha beta", "alpha, BETA gamma", "gamma", "éa ñb",
    ]
    items = [
        (1, item), (2, item), (2, prose(54, 30)), (3, "alpha beta"), (4, "gamma"), (5, " ".join(words[10:30])), (6, None),
        (7, "..."), (None, "éa ñb"), (8, " ".join(["echo"] * 20)), (1, item), (9, prose(8, 30_000)[:400]),
    ]
    check(spark, [*texts, "echo " * 40, "echo " * 12, "echo " * 13], items)


def test_random_small_vocabulary(spark):
    random.seed(9)
    texts = [" ".join(random.choice("ab") for _ in range(random.randint(0, 60))) for _ in range(60)]
    items = [(i, " ".join(random.choice("ab") for _ in range(random.randint(1, 20)))) for i in range(40)]
    check(spark, texts, items)


def test_nothing_to_find(spark):
    check(spark, [prose(1, 30)], [])
    check(spark, [prose(1, 30)], [(1, None), (2, "--")])
    check(spark, [prose(1, 30)], [(1, prose(99, 50))])
    assert decontaminate.contamination_report(no_documents(spark), bench(spark, [(1, "a b", "x")])).collect() == []


def test_contaminated_documents_go(spark):
    item = prose(50, 40)
    docs = documents(spark, item, prose(51, 2000) + " " + item, prose(52, 100))
    kept = decontaminate.drop_contaminated(docs, bench(spark, [(1, item, "x")]))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] and r["doc_id"] < 900) == [2, 3]
    assert kept.count() == docs.count() - 1


def test_main_path_has_no_python(spark):
    df = decontaminate.contamination_report(documents(spark, "a b"), bench(spark, [(1, "a b", "x")]))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())
