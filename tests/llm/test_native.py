"""Decontamination and surrogates, which use DataFrame functions only."""

import random
import re
import time

from pyspark.sql import functions as F

from weftline.llm import decontamination, pii, toxicity

ITEM = "Alice has 12 apples and gives 5 kg of them to her friend Bob Smith before the long walk home at 7"
OTHER = "the quick brown fox jumps over a lazy dog while seven small birds sing their song"
KEY = "a key for tests"
FILL = "plain words that stand around every passage of this corpus and mean nothing at all "


def items(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def contaminated(spark, documents, rows, *texts):
    found = decontamination.contamination(documents(rows), items(spark, *texts)).collect()
    assert len(found) == len(rows)
    return {r["doc_id"]: list(r["items"]) for r in found if r["contaminated"]}


def test_finds_exact_and_new_parameters(spark, documents):
    rows = [
        (1, FILL + ITEM + " " + FILL),
        (2, FILL + ITEM.replace("12", "31").replace("5 kg", "9 lbs").replace("Bob Smith", "Tom Jones").replace("at 7", "at 8") + "."),
        (3, FILL * 5),
        (4, None),
        (5, ""),
        (6, (FILL + OTHER.upper()).replace(" ", "### ")),
        (6, (FILL + OTHER.upper()).replace(" ", "### ")),
        (7, FILL + "the quick brown fox"),
        (None, OTHER),
    ]
    found = contaminated(spark, documents, rows, ITEM, OTHER, None, "", "too short")
    assert found == {1: [0], 2: [0], 6: [1], None: [1]}


def test_slots_must_agree(spark, documents):
    item = "a train leaves with 40 people and 40 more get on it at the next stop then 40 of all these people get off again"
    good = item.replace("40", "55")
    torn = item.replace("40", "55", 1).replace("40", "66", 1).replace("40", "77", 1)
    assert contaminated(spark, documents, [(1, FILL + good), (2, FILL + torn)], item) == {1: [0]}


def test_one_consistent_occurrence_is_enough(spark, documents):
    # 12 stands for 31 in one copy and for 44 in the other; within each all agrees.
    item = "a man has 12 apples in his bag and sells them for 5 coins each so how much are all 12 worth in coins"
    copies = [item.replace("12", a).replace("5 ", f"{b} ") for a, b in (("31", "8"), ("44", "9"))]
    torn = item.replace("12", "31", 1).replace("12", "77").replace("5 ", "8 ")
    # The same window twice in the item, with different numbers.
    twice = "first the farmer has 12 apples in his old barn today and then the farmer has 15 apples in his old barn today so count them"
    other = twice.replace("12", "71").replace("15", "93")
    rows = [
        (1, FILL + copies[0] + ". " + FILL + copies[1]),
        (2, FILL + torn),
        (3, FILL + torn + ". " + FILL + copies[0]),
        (4, FILL + other),
        (5, FILL + other.replace("and then", "and shortly after then")),
        (6, copies[0] + " " + copies[1] + " " + copies[0]),
        (7, FILL + torn.replace("bag and", "bag there and")),
    ]
    assert contaminated(spark, documents, rows, item, twice) == {1: [0], 3: [0], 4: [1], 5: [1], 6: [0]}


def test_number_heavy_and_unspaced_items(spark, documents, caplog):
    sums, chinese = "What is 12 + 7 + 30 + 4 + 5 + 6", "小明有12个苹果，他给了小红5个苹果，还剩下多少个苹果？"
    rows = [
        (1, FILL + sums + "? " + FILL),
        (2, FILL + sums.replace("7 + 30", "8 + 31") + "? " + FILL),
        (3, "这是一段普通的文字。" + chinese + "后面还有别的文字。"),
        (4, "这是一段普通的文字。" + chinese.replace("12", "31").replace("5", "9")),
        (5, "这是一段普通的文字，与题目没有任何关系。"),
    ]
    assert contaminated(spark, documents, rows, sums, chinese, None, "12 + 7") == {1: [0], 3: [1], 4: [1]}
    assert "2 benchmark items are too short" in caplog.text


def test_slots_must_agree_both_ways(spark, documents):
    item = "a train leaves with 40 people and 12 more get on it at the next stop so how many people are now on it"
    again = item + " if 12 of all the 40 people at the start get off"
    rows = [
        (1, FILL + again.replace("40", "55").replace("12", "31")),
        (2, FILL + again.replace("40", "55").replace("12", "55")),
        (3, FILL + again.replace("40", "12").replace(" 12 more", " 40 more").replace("if 12 of all the 12", "if 40 of all the 12")),
        (4, FILL + again),
    ]
    assert contaminated(spark, documents, rows, again) == {1: [0], 3: [0], 4: [0]}


def test_planted_items_at_random(spark, documents, monkeypatch):
    """Items with random parameters, once or twice in a document: found where one copy has one value for each
    of the item's and different ones for different ones. With small limits, hashes go as a filter, or all
    windows are shuffled."""
    rng = random.Random(9)
    names = ["Alder", "Birch", "Cedar", "Dogwood", "Elm", "Fir"]
    texts, slots = [], []
    for i in range(4):
        words = [f"w{i}x{j}" for j in range(40)]
        at = sorted(rng.sample(range(2, 38), 7))
        kinds = [rng.choice(["number", "number", "name"]) for _ in at]
        pool = {"number": ["12", "40", "7"], "name": names[:3]}
        texts.append((words, at, kinds, [rng.choice(pool[k]) for k in kinds]))
    make = lambda words, at, values: " ".join(w if j not in at else f"{w} {values[at.index(j)]}" for j, w in enumerate(words))
    rows, expected = [], {}
    for doc in range(60):
        i = rng.randrange(4)
        words, at, kinds, values = texts[i]
        copies, good = [], False
        for _ in range(rng.choice([1, 1, 2])):
            fresh = {"number": ["55", "66", "77", "88"], "name": names[3:]}
            new = [rng.choice(fresh[k]) for k in kinds]
            if rng.random() < 0.6:
                to = {}
                for k in fresh:
                    olds = sorted({v for v, kk in zip(values, kinds) if kk == k})
                    to |= dict(zip(olds, rng.sample(fresh[k], len(olds))))
                new = [to[v] for v in values]
            pairs = set(zip(values, new))
            good |= len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
            copies.append(make(words, at, new))
        rows.append((doc, FILL + (". " + FILL).join(copies)))
        if good:
            expected[doc] = [i]
    items_ = [make(w, at, v) for w, at, _, v in texts]
    assert 10 < len(expected) < 55
    assert contaminated(spark, documents, rows, *items_) == expected
    for limit, ids in ((3, 10**6), (3, 3)):
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", limit)
        monkeypatch.setattr(decontamination, "BROADCAST_IDS", ids)
        assert contaminated(spark, documents, rows, *items_) == expected


def test_decontamination_of_defined_cases(spark, documents):
    long = FILL * 15_000 + ITEM
    docs = documents([(1, long), (1, FILL), (2, None), (3, "")]).selectExpr("*", "1 AS key", "2 AS item", "3 AS window")
    named = items(spark, ITEM).selectExpr("cast(item_id AS string) AS item_id", "text")
    clean = decontamination.clean_documents(docs, named)
    assert clean.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in clean.collect() if r["text"]) == [(1, FILL)] and clean.count() == 3
    found = decontamination.contamination(docs, named).collect()
    assert sorted(r["contaminated"] for r in found) == [False, False, False, True] and max(list(r["items"]) for r in found) == ["0"]
    assert decontamination.contamination(documents([]), named).count() == 0


def test_short_items_and_no_items(spark, documents):
    assert contaminated(spark, documents, [(1, FILL + "five words are found here too"), (2, FILL)], "five words are found") == {1: [0]}
    assert contaminated(spark, documents, [(1, FILL)]) == {}
    docs = documents([(1, FILL + ITEM), (2, FILL), (3, None)])
    clean = decontamination.clean_documents(docs, items(spark, ITEM))
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [2, 3]


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def test_surrogates_keep_type_and_format(spark, documents):
    text = (
        "Write to jo.li@mail.example.com or +1 (017) 555-7713 from 97.51.17.173. Card 4929348385146306, "
        'Token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b", IBAN DE89 3704 0044 0532 0130 00, id 123-45-6789.'
    )
    rows = [(1, text), (2, "Again jo.li@mail.example.com and 4929 3483 8514 6306, not 4929348385146307 or version 2.0"), (3, None), (4, ""), (5, "clean text 2020 at 10:30")]
    docs = documents(rows)
    found = {r["doc_id"]: r for r in pii.replaced(docs, KEY, length="n_chars").collect()}
    new = found[1]["text"]
    for value in ("jo.li@mail.example.com", "555-7713", "97.51.17.173", "4929348385146306", "9233a8ecf7c5b09fe5949719b6b82bc439e9329b", "3704 0044 0532", "123-45-6789"):
        assert value not in new
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", s)))
    assert shape(new).replace("00.00.00.000", "") == shape(text).replace("00.00.00.000", "")
    assert luhn(re.search(r"Card (\d+)", new)[1])
    mail = re.search(r"\S+@\S+", new)[0]
    assert mail.endswith(".com") and mail in found[2]["text"]
    assert "4929348385146307" in found[2]["text"] and "version 2.0" in found[2]["text"]
    assert found[3]["text"] is None and found[4]["text"] == "" and found[5]["text"] == "clean text 2020 at 10:30"
    assert [found[i]["n_replaced"] for i in (3, 4, 5)] == [0, 0, 0]
    assert pii.pseudonymised(docs, KEY).columns == docs.columns


def test_names_keep_gender_script_and_coreference(spark, documents):
    rows = [(1, "Mrs. Linda Barker met Mr. Barker and Иван Петров; then John Barker left."), (2, "Linda Barker again.")]
    found = {r["doc_id"]: r["text"] for r in pii.replaced(documents(rows), KEY).collect()}
    m = re.match(r"Mrs\. (\S+) (\S+) met Mr\. (\S+) and (\S+) (\S+); then (\S+) (\S+) left\.", found[1])
    first, last, again, ivan, petrov, john, third = m.groups()
    assert last == again == third != "Barker" and first.endswith("a") and john.endswith("o")
    assert re.fullmatch(r"[А-Яа-я]+", ivan + petrov)
    assert found[2] == f"{first} {last} again."


def test_surrogates_are_distinct(spark):
    values = [f"{a}.{b}.1.1" for a in range(1, 10) for b in range(1, 10)]
    rows = spark.createDataFrame([("ip", v, None) for v in values], "kind string, value string, gender string")
    made = [r["surrogate"] for r in pii.surrogates(rows, KEY).collect()]
    assert len(made) == len(set(made)) == len(values) and not set(made) & set(values)
    assert pii.replaced(spark.createDataFrame([], "doc_id long, text string"), KEY).count() == 0


def test_surrogates_never_run_out(spark):
    surnames = [("part", f"Name{i}") for i in range(100_000)]  # 16^4 names have four syllables
    addresses = [("ip", ".".join(f"{i:04d}")) for i in range(10_000)]  # all of four one-digit octets
    others = [("secret", "password=--------"), *[("email", f"{c}@{d}.com") for c in "abcdefghijklmnopqrstuvwxyz" for d in "abcdefghijklmnopqrstuvwxyz"]]
    values = [(k, v, None) for k, v in surnames + addresses + others]
    made = pii.surrogates(spark.createDataFrame(values, "kind string, value string, gender string"), KEY).collect()
    new = {(r["kind"], r["surrogate"]) for r in made}
    assert len(made) == len(new) == len(values) and not new & {(k, v) for k, v, _ in values}
    assert all(re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", v) for k, v in new if k == "ip")
    assert all(re.fullmatch(r"[a-z]+@[a-z]\.com", v) for k, v in new if k == "email")


def test_no_python_in_the_plans(spark, documents):
    docs = documents([(1, ITEM)])
    for plan in (decontamination.contamination(docs, items(spark, ITEM)), pii.replaced(docs, KEY)):
        text = plan._jdf.queryExecution().toString()
        assert "Python" not in text and "Arrow" not in text


def test_names_by_context_and_alone(spark, documents):
    rows = [
        (1, "Mr. Zhou met Priya Raman, Kwame Mensah and Wei Zhang; mail zhou.wei@x.org, then Zhou left. Call 020 7946 0958. Zhou's hat and Raman stayed."),
        (2, "Zhou without a title, and Bank of New York, are no names here."),
        (3, "Call 030 1234567 or 01 23 45 67 89 or 089/123456, not on 01.02.2024 or 2024-01-02 or at 0.123 456."),
        (4, "Dr. O'Brien and Mrs. McDonald's dog"),
    ]
    found = {r["doc_id"]: r["text"] for r in pii.replaced(documents(rows), KEY).collect()}
    for name in ("Zhou", "Priya", "Raman", "Kwame", "Mensah", "Wei", "Zhang", "zhou.wei", "7946"):
        assert name not in found[1]
    m = re.match(r"Mr\. (\w+) met (\w+) (\w+), \w+ \w+ and \w+ \w+; mail \S+, then (\w+) left\. Call 0?\S+ \S+ \S+\. (\w+)'s hat and (\w+) stayed\.", found[1])
    assert m[1] == m[4] == m[5] and m[3] == m[6] and len({m[1], m[2], m[3]}) == 3
    assert found[2] == rows[1][1]
    assert found[3].endswith(", not on 01.02.2024 or 2024-01-02 or at 0.123 456.") and not re.search("1234567|01 23 45|123456", found[3])
    assert "Brien" not in found[4] and "McDonald" not in found[4] and found[4].endswith("'s dog")


def test_recall_of_introduced_names_outside_the_lists(spark, documents):
    """All of 300 made-up names, in sentences that introduce them, go."""
    cues = ["My name is {}", "Dear {},", "Please contact {} for it", "we met {} there", "written by {}", "Sincerely, {}", "Patient: {}", "Ich heiße {}", "je m'appelle {}", "me llamo {}"]
    names = [f"{a}{b} {c}{d}" for a in ("Qu", "Xo", "Ny") for b in ("ilo", "anth", "essa", "ur", "ima") for c in ("Dra", "Vel", "Mc", "O'") for d in ("Gund", "Zerath", "Holm", "Prax", "Tomer")]
    rows = [(i, f"Some words first. {cues[i % 10].format(n)} and so on.") for i, n in enumerate(names)]
    found = {r["doc_id"]: r["text"] for r in pii.replaced(documents(rows), KEY).collect()}
    assert sum(n.split()[1] in found[i] or n.split()[0] in found[i] for i, n in enumerate(names)) <= 0.1 * len(names)


def test_surrogates_of_defined_cases(spark, documents):
    long = "Clean words go here. " * 60_000 + "mail a.person@host.example.org"
    docs = documents([(1, long), (1, long), (1, "mail a.person@host.example.org"), (None, "mail a.person@host.example.org"), (2, None), (3, "")])
    docs = docs.selectExpr("*", "1 AS value", "2 AS hash", "3 AS new", "4 AS id", "5 AS n_replaced")
    found = pii.replaced(docs, KEY)
    assert found.columns == [*docs.columns[:-1], "n_replaced"]
    rows = found.collect()
    assert [r["n_replaced"] for r in rows if r["text"]] == [1, 1, 1, 1] and len(rows) == 6
    assert len({r["text"][-30:] for r in rows if r["text"]}) == 1 and "a.person" not in rows[0]["text"]
    other = pii.replaced(docs, "another key").where("doc_id IS NULL").first()
    assert other["text"] != next(r["text"] for r in rows if r["doc_id"] is None)


LONG = ["ACGT" * 250_000, "Aa-" * 300_000, "a_" * 500_000, "." * 1_000_000, "QUJD" * 250_000, "Aa'" * 300_000, "1a:" * 300_000, "A b " * 200_000]


def test_very_long_words_take_linear_time(spark, documents):
    docs = documents([(i, t) for i, t in enumerate(LONG)] + [(100, "Dear Ravi Kumar, hello")])
    began = time.monotonic()
    found = {r["doc_id"]: r["text"] for r in pii.replaced(docs, "k").collect()}
    assert all(found[i] == t for i, t in enumerate(LONG)) and "Kumar" not in found[100]
    assert time.monotonic() - began < 180
    assert sum(toxicity.hidden_insults(t) for t in LONG) == 0


def test_lists_of_names_and_names_of_many_parts_go(spark, documents):
    names = ["Ravi Kumar", "Mei Lin", "Jean-Luc Picardo Alvarez Montenegro", "Oskar Brandt", "Fatima Alsayedovnabenhassanalrashidi", "Kofi Mensah"]
    text = "Dear " + ", ".join(names[:-1]) + " and " + names[-1] + ", please write. Kumar is late."
    made = pii.replaced(documents([(1, text)]), "k").first()["text"]
    assert not any(part in made for name in names for part in name.split())
    assert made.startswith("Dear ") and made.endswith(" is late.") and made.count(",") == text.count(",") and " and " in made


def test_accounts_addresses_and_devices_keep_their_form(spark, documents):
    values = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "DE00370400440532013000", "2001:db8::1", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "00:1A:2b:3c:4D:5e", "00-1A-2B-3C-4D-5E"]
    made = [pii.replaced(documents([(1, f"see {v} now")]), "k").first()["text"][4:-4] for v in values]

    def remainder(account):
        plain = account.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97

    for value, new in zip(values, made):
        assert new != value and re.sub("[0-9A-Za-z]", "x", new) == re.sub("[0-9A-Za-z]", "x", value)
    assert [remainder(v) == 1 for v in made[:3]] == [True, True, False]
    assert made[0][:2] == "DE" and all(int(g or "0", 16) >= 0 for v in made[3:] for g in re.split("[:-]", v))
    plain = "at 10:30:15, std::vector, a::b::c, 12:34 and ratio 1:2:3"
    assert pii.replaced(documents([(1, plain)]), "k").first()["text"] == plain


PROMPT = "Answer the following question and give short reasons for your choice in two or three full sentences please: "


def made_items(n):
    rng = random.Random(8)
    words = ["river", "castle", "engine", "lemon", "violet", "harbour", "copper", "meadow", "lantern", "saddle", "winter", "basket", "marble", "falcon", "ribbon", "cellar", "hammer", "island", "pepper", "mirror"]
    return [(i, PROMPT + " ".join(rng.choice(words) for _ in range(12)) + " twelve times") for i in range(n)]


def test_a_common_prompt_is_no_evidence(spark, documents):
    items = made_items(200)
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, PROMPT + "nothing of it") for i in range(200)]
    rows += [(1000 + i, "Some words before. " + t.replace("twelve", "31") + " And some after.") for i, t in items]
    rows += [(2000 + i, f"All in all {t[len(PROMPT):]} is what it says.") for i, t in items]
    found = {r["doc_id"]: (r["contaminated"], r["items"]) for r in decontamination.contamination(documents(rows), table).collect()}
    assert not any(found[i][0] for i in range(200))
    assert sum(found[1000 + i][1] == [i] for i, _ in items) >= 0.95 * len(items)
    assert sum(found[2000 + i][1] == [i] for i, _ in items) >= 0.95 * len(items)
    # Each document has the windows of one item at most: hits don't grow with the number of items.
    windows = decontamination.benchmark_windows(table)
    assert windows.groupBy("window").agg(F.count_distinct("item").alias("n")).agg(F.max("n")).first()[0] <= decontamination.SHARED_ITEMS
    # Items that are equal but for a number have no windows of their own, and are found all the same.
    twins = spark.createDataFrame([(i, f"How far does a train go in {i + 2} hours if it runs at the same speed all day long") for i in range(9)], "item_id long, text string")
    both = decontamination.contamination(documents([(1, "How far does a train go in 40 hours if it runs at the same speed all day long?"), (2, "A train goes far.")]), twins)
    assert {r["doc_id"]: len(r["items"]) for r in both.collect()} == {1: 9, 2: 0}


def test_number_words_are_slots(spark, documents):
    items = spark.createDataFrame([(1, "A farmer has twelve sheep and sells five sheep to a neighbour, so how many sheep are left on the farm")], "item_id long, text string")
    same = "A farmer has {} sheep and sells {} sheep to a neighbour, so how many sheep are left on the farm?"
    rows = [(1, same.format("12", "5")), (2, same.format("twenty-one", "seven")), (3, same.format("nine", "3"))]
    assert all(r["contaminated"] for r in decontamination.contamination(documents(rows), items).collect())
