import random

import pytest

from skeinflow.llm import containers, tokens
from skeinflow.llm.residue import classify, find_residue, normalise, without_residue
from tests.llm import foreign_texts

PATH = f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"
HARD = ["", " ", "\n\n  x", "it's we'll", "<|endoftext|>", "Đồ thị quanh luồng", "👨‍💻 𝕏𝕐 مراقبة 流量異常", "a" * 50, "12345 67", "\x00\x01", "tab\tnew\r\nline  end ", "�"]


def test_encoding_equals_the_published_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    enc = tokens.encoding(PATH)
    rnd = random.Random(1)
    texts = HARD + ["".join(rnd.choice(["a", "B", " ", "  ", "\n", "'s", "9", "é", "!", "語", "\t"]) for _ in range(400)) for _ in range(20)]
    for x in texts:
        want = t.encode(x, add_special_tokens=False).ids
        assert tokens.encode(x, enc) == want
        for size in (1, 7, 50):
            assert tokens.encode(x, enc, long=size) == want, (x, size)


def test_null_and_very_long_texts(spark):
    long = "word 12 " * 60_000 + "a" * 250_000 + " " * 250_000 + "end"
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, long, "x"), (4, "hi", None)], "doc_id long, text string, ids string")
    ids = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(df).collect()}
    assert ids[1] == [] and ids[2] == [] and tokens.encoding(PATH).decode_bytes(ids[3]).decode() == long
    n = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df).collect()}
    assert n == {k: len(v) for k, v in ids.items()}
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def test_round_trip(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*HARD, None])], "doc_id long, text string")
    assert tokens.round_trip(df).where("not exact").count() == 0 and tokens.round_trip(df).count() == len(HARD) + 1


def brute_check(counts, capacity):
    p = containers.Plan(counts, capacity)
    segments = sorted(p.segments, key=lambda s: (s.size, s.first))
    fill, large = {}, {}
    for size, n in counts.items():
        own = [s for s in segments if s.size == size]
        for r in range(n):
            s = [x for x in own if x.first <= r][-1]
            at = s.container + (r - s.first) // s.per
            fill[at] = fill.get(at, 0) + size
            large[at] = large.get(at, 0) + (3 * size > capacity)
    assert set(fill) == set(range(p.containers)) and all(v <= capacity for v in fill.values()) and all(v <= 2 for v in large.values())
    return p.containers


def test_plans_are_valid_and_tight():
    rnd = random.Random(2)
    for _ in range(300):
        capacity = rnd.choice([1, 2, 3, 10, 64])
        counts = {s: rnd.choice([1, 2, 3, 40]) for s in rnd.sample(range(1, capacity + 1), rnd.randint(0, min(capacity, 12)))}
        n = brute_check(counts, capacity)
        least = -(-sum(s * c for s, c in counts.items()) // capacity)
        big = sum(c for s, c in counts.items() if 2 * s > capacity)
        assert n <= 1.5 * max(least, big) + 1
    with pytest.raises(ValueError):
        containers.Plan({5: 1}, 4)


def test_packing_keeps_every_text(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, 0, 1, 30, 100, 101, 250, 64, 64, 64, rnd.randrange(1, 120)]), "x") for i in range(500)] + [(7, 64, "x")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, container_id string")
    got = containers.pack(df, 100).collect()
    whole = {}
    for r in got:
        whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + r["n_tokens"]
        assert (r["container_id"] is None) == (r["n_tokens"] == 0) and r["from_token"] == r["piece_no"] * 100
    want = {}
    for i, n, _ in rows:
        want[i] = want.get(i, 0) + (n or 0)
    assert whole == want
    used = {}
    for r in got:
        if r["container_id"] is not None:
            used[r["container_id"]] = used.get(r["container_id"], 0) + r["n_tokens"]
    assert max(used.values()) <= 100 and sorted(used) == list(range(len(used)))
    split = {r["doc_id"] for r in got if r["piece_no"] > 0}
    assert split == {i for i, n, _ in rows if n and n > 100}
    again = containers.pack(df.repartition(5), 100).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)
    report = containers.fill_report(containers.pack_each(df, [100, 7])).where("capacity = 100").first()
    assert report["n_containers"] == len(used) and report["filled"] > 0.9
    assert containers.pack(df.limit(0), 100).count() == 0
    both = containers.pack_each(df, [100, 7])
    assert sorted(map(tuple, both.where("capacity = 100").drop("capacity").collect()), key=str) == sorted(map(tuple, got), key=str)


def test_broken_rules_are_counted(spark):
    sized = spark.createDataFrame([(1, 5), (2, 12), (3, None), (4, 3)], "doc_id long, n_tokens long")
    good = containers.pack_each(sized, [5, 10])
    assert {tuple(r) for r in containers.broken_rules(good, sized).select("capacity", "n_texts", "n_over_full", "n_cut_though_fitting", "n_not_adding_up").collect()} == {(5, 4, 0, 0, 0), (10, 4, 0, 0, 0)}
    bad = spark.createDataFrame([(10, 1, 0, 0, 3, 0), (10, 1, 1, 10, 2, 0), (10, 2, 0, 0, 9, 0), (10, 3, 0, 0, 0, None), (10, 4, 0, 0, 3, 1)], "capacity long, doc_id long, piece_no long, from_token long, n_tokens long, container_id long")
    r = containers.broken_rules(bad, sized).first()
    assert (r["n_texts"], r["n_over_full"], r["n_cut_though_fitting"], r["n_not_adding_up"]) == (4, 1, 1, 1)


CASES = {
    "placeholder": [
        "Host {{src_host}} opened 3 flows.", "Site: ${site}", "Flow id: [FLOW_ID]", "Shift: %(shift)s", "Summary: <% summary %>", "Site: $SITE$", "Shift: %SHIFT%", "Next step: TBD - owner",
        "Family: (TODO: add family)", "Kỹ thuật (CẦN BỔ SUNG: top technique) phù hợp.", "Site: ________ (site)", "Src: <<src host>>", "Src: <fill in the src host>", "Wert: <summary einfügen>",
        "Shift: [insert shift here]", "Shift: [shift goes here]", "Shift: [điền shift vào đây]", "x: {{{flow_id|default}}}", "x: #{target}", "x: @@site@@", "x: __SRC_HOST__", "x: [[shift]]", "x: {% shift %}",
        "Von <hier target eintragen> kam keine Antwort.",
    ],
    "filler": [
        "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "test entry. test entry. test entry. test entry. test entry. test entry.", "asdf qwer asdf zxcv jkl asdf qwer xxx yyy asdf qwer zxcv",
        "Write the summary of the incident in this place. Two or three sentences are enough.", "Đoạn này chỉ để giữ chỗ.", "Dieser Absatz steht nur als Ersatz hier.", "văn bản mẫu, văn bản mẫu, văn bản mẫu, văn bản mẫu, văn bản mẫu, văn bản mẫu",
    ],
    "error": [
        "502 Bad Gateway\nThe report gateway could not complete the request.", "<html><head><title>403 Forbidden</title></head><body></body></html>", '{"error": {"code": 404, "message": "not found"}}',
        "Traceback (most recent call last):\n  File \"x.py\"", "org.flowstore.StoreException: shard 3 is sealed", "Access denied. Your account has no right to open this case.", "Your session has expired.",
        "Oops! Something went wrong.", "Lỗi 404: không tìm thấy trang.", "Fehler 404: Die Seite wurde nicht gefunden.", "Connection to the language model timed out after 30 s; no report was written.",
    ],
    "script_notice": [
        "Please enable JavaScript to view this dashboard.", "Loading...\n<noscript>You need to allow scripts to use the page.</noscript>", "This report page needs scripts to run.", "Checking your browser before the viewer opens.",
        "Bitte aktivieren Sie JavaScript, um diese Ansicht zu öffnen.", "Trang này cần chạy tập lệnh mới hiển thị được nội dung.", "JavaScript is disabled. The page cannot be shown without it.",
    ],
    None: [
        None, "", "  \n ", "The probe sent `{{7*7}}` in the parameter q.", 'Payload: "${summary}" was found in 9 requests and belongs to the lookup attack on the logger.',
        "The exporter replaces {{ site }} in the template before the report is sent.", "The format string %(site)s in the request shows a test for unsafe logging.", "Die Anfrage enthielt `${site}` und traf 9 Mal.",
        "The fake login page of 10.0.0.1 holds the words lorem ipsum as filler, which gave it away.", '271 clients got the challenge page with the words "Please enable JavaScript", and bots stopped there.',
        'The body of the reply read "502 Bad Gateway" 9 times, so the proxy shed load.', "10.0.0.1 answered 404 Not Found to 9 of the requests, which fits a path walk.", "The page at 10.0.0.1 used <noscript> to load an image.",
        "[FLOW] flow_1 src=10.0.0.1\n[EDGE] packet#0 -> TX1 family=recon\n[NOTE] ok", "Content [PAD][UNK] </s> <s> goes on <|endoftext|> here.", "72.8 % of the payloads and 79.2 % of the bytes are printable.",
        "```\nSite: {{ site }}\n```\nshows how the field is written.", "Both directions were merged under one key before features were computed.",
    ],
}


@pytest.mark.parametrize("kind", list(CASES))
def test_residue_kinds(kind):
    for text in CASES[kind]:
        assert classify(text) == kind, text


@pytest.mark.parametrize("mark", ["TECHNIQUE", "LABEL", "TACTIC", "EVIDENCE", "HOST", "END", "SITE"])
def test_residue_bracketed_fields(mark):
    for text in (f"Technique [{mark}] is the best match.", f"Confidence: [{mark}]", f"[{mark}] opened 3 flows.", f"[FLOW] flow_1 src=10.0.0.1\n[NOTE] Matches [{mark}] best."):
        assert classify(text) == "placeholder", text


@pytest.mark.parametrize("texts", [foreign_texts.DEV, foreign_texts.HELD_OUT], ids=["dev", "held_out"])
def test_residue_in_texts_from_elsewhere(texts):
    found = [(kind is not None, classify(text) is not None) for kind, text in texts]
    true = sum(kind and hit for kind, hit in found)
    assert true / sum(kind for kind, _ in found) > 0.9 and true / sum(hit for _, hit in found) > 0.9
    assert len(foreign_texts.HELD_OUT) >= 200 and not {t for _, t in foreign_texts.DEV} & {t for _, t in foreign_texts.HELD_OUT}


def test_residue_in_very_long_lines_and_traces():
    quoted = 'the reply held "{{ name }}" again, ' * 30_000
    assert classify(quoted) is None and classify(quoted + "Host ${src_host} came back.") == "placeholder"
    trace = "app.Failure: broken\n" + "\tat app.Main.run(Main.java:5)\n" * 900
    assert classify(trace) == "error" and classify("Report of the night\n" + trace) == "error"


def test_residue_density_and_code():
    tutorial = "A template engine expands each tag. The syntax is short: the variable name stands in braces, so write {{ name }} or {{ city }} where the value goes."
    assert classify(tutorial) is None and classify("Name: {{ name }}\nCity: {{ city }}") == "placeholder"
    assert classify("~~~\nName: {{ name }}\n~~~\nThe fields above are set in code.") is None and classify("<pre>Name: ${name}</pre> is code.") is None


def test_residue_section_marks_open_lines():
    assert classify("[FLOW] flow_1 src=10.0.0.1\n流量異常[EDGE] packet#0 -> TX1\n 3.14e+10[HEX] 00ff\ndon't we'll IT'S[TOKENS] t:wget\n[PAD][UNK][NOTE] ok") is None
    assert classify("The evidence on [FLOW] reaches weight 0.9.") == "placeholder" and classify("Note: [NOTE]") == "placeholder"


def test_residue_in_long_text_and_marks():
    body = "The graph around the flow holds 3 packets, 4 hosts and 5 technique edges. " * 800
    assert classify(body) is None and classify(body + "Host ${src_host} came back.") == "placeholder"
    assert normalise("a​b﻿  c\r\n d") == "ab c\n\nd"


def test_residue_operators(spark):
    rows = [(1, "Site: ${site}", "s"), (2, None, "s"), (3, "", None), (4, "fine text here", "s"), (4, "fine text here", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, residue string")
    assert sorted((r["doc_id"], r["residue"]) for r in find_residue(df).where("residue is not null").collect()) == [(1, "placeholder")]
    assert sorted(r["doc_id"] for r in without_residue(df).collect()) == [2, 3, 4, 4]
    assert find_residue(df.limit(0)).count() == 0
