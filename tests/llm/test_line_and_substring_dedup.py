import random
import re
from collections import Counter, defaultdict

import numpy as np
from llm_rows import DOCS, words

from changetrail.llm import line_dedup, substring_dedup
from changetrail.llm.text_arrays import mix, word_hashes


def brute_lines(rows):
    seen, index, out = [], defaultdict(list), {}
    for doc_id, text, *_ in sorted(rows):
        kept, removed = [], 0
        for line in (text or "").split("\n"):
            w = re.split(r"[\x20\x09-\x0D]+", line.lower())
            w = [x for x in w if x]
            own = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
            shared = Counter(k for token in own for k in index[token])
            if any(4 * n >= 3 * (len(own) + len(seen[k]) - n) for k, n in shared.items()):
                removed += 1
            else:
                kept.append(line)
            if own:
                for token in own:
                    index[token].append(len(seen))
                seen.append(own)
        out[doc_id] = (None if text is None else "\n".join(kept), removed)
    return out


def test_lines_equal_brute_force(unique_docs, unique_rows):
    found = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(unique_docs).collect()}
    assert found == brute_lines(unique_rows)


def test_many_variants_of_one_line(spark):
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(rnd.randint(0, 3)):
            own[rnd.randrange(40)] = f"v{rnd.randrange(50)}"
        rows.append((i, " ".join(own) + "\nshared tail of the text\n" + f"own line {i}", None, None, None))
    found = {r["doc_id"]: (r["text"], r["n_removed"])
             for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert found == brute_lines(rows)


MARKS = re.escape(substring_dedup.ENDS + substring_dedup.OTHER_ENDS)


def chosen(word):
    raw = word.encode()
    value, _ = word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return int(mix(value)[0]) % 6 == 0


def sentences(text):
    out = []
    for part in re.findall(f"[^{MARKS}]*[{MARKS}]+|[^{MARKS}]+$", text or ""):
        begin = 0
        for k, match in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", part)):
            if k >= 8 and chosen(match[0]):
                out.append(part[begin:match.start()])
                begin = match.start()
        out.append(part[begin:])
    return out


def brute_substrings(rows):
    seen, out = set(), {}
    for doc_id, text, *_ in sorted(rows):
        parts = sentences(text)
        own = [(i, tuple(words(p))) for i, p in enumerate(parts) if words(p)]
        covered = set()
        for i in range(len(own)):
            run, size = [], 0
            for number, w in own[i:]:
                run.append(w)
                size += sum(len(x.encode()) for x in w)
                if len(run) >= 2 and size >= 160:
                    if tuple(run) in seen:
                        covered |= set(range(own[i][0], number + 1))
                    seen.add(tuple(run))
                    break
        out[doc_id] = (None if text is None else
                       "".join(p for i, p in enumerate(parts) if i not in covered), len(covered))
    return out


def test_substrings_equal_brute_force(unique_docs, unique_rows):
    found = {r["doc_id"]: (r["text"], r["n_removed"])
             for r in substring_dedup.dedup_substrings(unique_docs).collect()}
    assert found == brute_substrings(unique_rows)


def without_repeats(spark, *texts):
    rows = [(i, text, None, None, None) for i, text in enumerate(texts)]
    found = substring_dedup.dedup_substrings(spark.createDataFrame(rows, DOCS)).collect()
    return [r["text"] for r in sorted(found, key=lambda r: r["doc_id"])]


def test_passages_of_fifty_words_are_caught(spark):
    rnd = random.Random(11)
    say = lambda k: " ".join(f"w{rnd.randrange(5000)}" for _ in range(k))
    passage = ", ".join(say(rnd.randint(5, 9)) for _ in range(8)) + "."
    found = without_repeats(spark, *[f"{say(30)}. {say(7)} {passage} {say(6)}. {say(20)}." for _ in range(40)])
    inner = passage.split(", ")[2:-1]
    assert all(part in found[0] for part in inner)
    assert not any(part in text for part in inner for text in found[1:])


def test_passages_without_end_marks_are_caught(spark):
    """Fifty words in the middle of others, without a mark far and wide."""
    rnd, caught = random.Random(12), 0
    say = lambda k: " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(k))
    for _ in range(20):
        passage = say(60)
        texts = [f"{say(rnd.randint(0, 40))} {passage} {say(rnd.randint(0, 40))}" for _ in range(2)]
        first, second = without_repeats(spark, *texts)
        assert first == texts[0]
        gone = len(texts[1].split()) - len(second.split())
        caught += gone >= 20
        assert gone <= 60
    assert caught >= 18


def test_short_copies_and_unspaced_scripts_are_caught(spark):
    plain = " ".join(f"word{i}" for i in range(60))
    signs = "".join(f"{chr(0x4E00 + i)}{chr(0x5E00 + i)}{chr(0x6E00 + i)}{chr(0x7E00 + i)}。" for i in range(18))
    for text in (plain, signs):
        first, second = without_repeats(spark, text, text)
        assert first == text and len(second) < len(text) / 2
    # Repeats that are no passage stay.
    lines = "thanks for reading, see you soon."
    assert without_repeats(spark, lines, lines + " more") == [lines, lines + " more"]


def check_odd_rows(operator, docs, rows, clashing, empty, counter):
    plain = operator(docs).collect()
    assert len(plain) == len(rows)
    assert sum(r["text"] is None for r in plain) == sum(r[1] is None for r in rows)
    # Columns with the names of the counts give way to them.
    own = [name for name in clashing.columns if name not in (counter, "n_removed")]
    carried = operator(clashing.withColumn(counter, clashing["_gone"]))
    assert carried.columns == [*own, counter, "n_removed"]
    assert sorted(r["n_removed"] for r in carried.collect()) == sorted(r["n_removed"] for r in plain)
    texts = lambda frame: sorted((str(r["doc_id"]), str(r["text"])) for r in frame)
    assert texts(carried.collect()) == texts(plain)
    assert {r["_gone"] for r in carried.collect()} == {"_gone"}
    assert operator(empty).count() == 0


def test_odd_rows_of_lines(docs, rows, clashing, empty):
    check_odd_rows(line_dedup.dedup_lines, docs, rows, clashing, empty, "n_lines")


def test_odd_rows_of_substrings(docs, rows, clashing, empty):
    check_odd_rows(substring_dedup.dedup_substrings, docs, rows, clashing, empty, "n_sentences")


def test_ids_out_of_range_are_ranked(spark, unique_rows):
    wide = [(row[0] * 10**15 - 10**17, *row[1:]) for row in unique_rows]
    found = {r["doc_id"]: (r["text"], r["n_removed"])
             for r in line_dedup.dedup_lines(spark.createDataFrame(wide, DOCS)).collect()}
    assert found == brute_lines(wide)


def test_short_lines_of_one_32_bit_hash_stay(spark):
    from pyspark.sql import functions as F

    made = spark.range(300000).select(F.concat_ws(" ", F.lit("line"), F.col("id").cast("string")).alias("line"))
    alike = [r["own"] for r in made.groupBy(F.hash(F.split("line", " "))).agg(
        F.sort_array(F.collect_list("line")).alias("own")).where(F.size("own") > 1).collect()]
    assert alike
    rows = [(i, "\n".join(own[i] for own in alike), None, None, None) for i in (0, 1)]
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert found == {row[0]: row[1] for row in rows}


def test_texts_without_an_id_or_of_one_id_have_their_own_places(spark):
    say = lambda name: ". ".join(" ".join(f"{name}{i}x{j}" for j in range(6)) for i in range(4)) + "."
    shared = ("a shared line of several rather plain words for everybody. and some more of it follows here, "
              "which is long enough to be a passage by itself. and further words of the same kind until its end, "
              "and at last its end is this.\n")
    for key in (None, 5):
        rows = [(key, shared + say(name) + "\n" + say(name + "z"), None, None, None) for name in "abcd"]
        rows.append((1, shared, None, None, None))
        docs = spark.createDataFrame(rows, DOCS)
        for operator in (line_dedup.dedup_lines, substring_dedup.dedup_substrings):
            found = operator(docs).collect()
            assert [r["text"] for r in found if r["doc_id"] == 1] == [shared]
            assert sorted(r["text"].strip() for r in found if r["doc_id"] == key) == [
                say(name) + "\n" + say(name + "z") for name in "abcd"]
        # A line that stands at the same place of two of them goes from one; no other text does.
        twins = [(key, "own first line of " + name + "\n" + shared + "own last line of " + name, None, None, None)
                 for name in ("north", "south")]
        lines = [line for r in line_dedup.dedup_lines(spark.createDataFrame(twins, DOCS)).collect()
                 for line in r["text"].split("\n")]
        assert sorted(lines) == sorted(["own first line of north", "own first line of south", shared.strip(),
                                        "own last line of north", "own last line of south"])


def test_lines_that_cannot_be_similar_are_not_read_again(spark, monkeypatch):
    """Every token of the long line is a line of its own: ten common rare tokens, but sizes 36 and 1."""
    from changetrail.llm import storage

    tables, own = {}, storage.written

    def recorded(frame, name):
        made = own(frame, name)
        tables[name] = tables.get(name, 0) + made.count()
        return made

    monkeypatch.setattr(line_dedup, "written", recorded)
    w = [f"w{i}" for i in range(40)]
    texts = [" ".join(w)] + [" ".join(w[i:i + 5]) for i in range(36)]
    rows = [(i, text, None, None, None) for i, text in enumerate(texts)]
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert found == dict(enumerate(texts))
    assert tables["lines"] == len(texts) and tables["sets"] == 0


def test_tokens_of_all_lines_do_not_stay_on_disk(spark, unique_docs, unique_rows):
    import os

    from changetrail.llm import storage

    folder = storage.shared_folder(spark).removeprefix("file:")
    tables = lambda: {name for name in os.listdir(folder) if name.startswith("lines-")}
    before = tables() if os.path.isdir(folder) else set()
    found = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(unique_docs).collect()}
    assert found == brute_lines(unique_rows)
    assert tables() == before


def test_lines_of_equal_tokens_but_other_words_go(spark):
    """The same run of six words three and four times over: other words, the same set of tokens."""
    once = "a1 b2 c3 d4 e5 f6"
    texts = [" ".join([once] * 3), " ".join([once] * 4), " ".join([once.upper()] * 3), "A1  b2\tc3 d4 \x0be5 f6 " * 4]
    rows = [(i, text, None, None, None) for i, text in enumerate(texts)]
    found = {r["doc_id"]: (r["text"], r["n_removed"])
             for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert found == brute_lines(rows)
    assert [found[i][1] for i in range(4)] == [0, 1, 1, 1]
