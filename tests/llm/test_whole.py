"""Rows that shortcuts of the training-data operators used to lose."""

import numpy as np
import pytest

from barflow.llm import decontamination, line_dedup, simhash, url_filter


def test_every_pair_at_the_similarity_is_found(spark):
    """Pairs of similarity 0.8 exactly (160 shingles of 200), with no third text to bridge them."""
    rng, rows = np.random.default_rng(11), []
    for k in range(300):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 184)]
        other = [f"x{k}" if n in (20, 60, 100, 140) else w for n, w in enumerate(words)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    near = [f"w{x}" for x in rng.integers(0, 10**9, 183)]
    rows += [(900, " ".join(near)), (901, " ".join("x" if n in (20, 60, 100, 140) else w for n, w in enumerate(near)))]
    found = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r["id"]: r["component_id"] for r in found}
    assert got == {i: i if i >= 900 else i - i % 2 for i, _ in rows}


def test_hot_shingles_lose_no_pair(spark):
    """Against brute force, with passages that many texts hold and groups of copies of all similarities."""
    rng, rows = np.random.default_rng(12), []
    noise = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    passage, base = noise(60), noise(120)
    for k in range(60):
        rows.append((k, " ".join(noise(int(rng.integers(5, 90))) + passage)))
        rows.append((100 + k, " ".join(w if rng.random() > 0.015 else "x" for w in base)))
    rows += [(200, "few words"), (201, "few words"), (202, ""), (203, None), (204, " ".join(passage))]
    found = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r["id"]: r["component_id"] for r in found}
    sets = {i: set(simhash.shingle_set(t or "").tolist()) for i, t in rows}
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    assert got == {i: find(i) for i in sets}


def test_boilerplate_that_is_the_longest_line_leaves(spark):
    notice = " ".join(f"notice{k}" for k in range(60))
    rows = [(k, f"first own line {k}\nsecond own line {k}\nline of them all\n{notice}", f"s{k}") for k in range(20)]
    rows += [(100 + k, "a text that was copied as a whole\nsame line one here\nsame line two here", f"s{k}") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in line_dedup.strip_boilerplate(docs).collect()}
    for k in range(20):
        assert (got[k]["text"], got[k]["n_lines_removed"]) == (f"first own line {k}\nsecond own line {k}", 2)
    assert all(got[100 + k]["n_lines_removed"] == 3 for k in range(6))
    once = {r["doc_id"]: r["n_lines_removed"] for r in line_dedup.strip_boilerplate(docs, copies_once=True).collect()}
    assert all(once[100 + k] == 0 for k in range(6)) and all(once[k] == 2 for k in range(20))


def test_a_footer_on_forty_sites_leaves_all_its_documents(spark):
    """The sketches decide what is far from the threshold, the exact count what is near; a footer may be the longest line or the only one shared."""
    rows = [(k, f"own words of page {k}\nall rights reserved by the owners of this site and of all its pages", f"s{k}") for k in range(40)]
    rows += [(100 + k, f"another page says {k}\nseen on thirty nine sites only", f"s{k}") for k in range(39)]
    rows += [(200 + k, f"a page of its own {k}\nseen on far too many sites", f"s{k}") for k in range(200)]
    rows += [(500 + k, f"the last kind of page {k}\nseen on a few sites", f"s{k % 10}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in line_dedup.strip_boilerplate(docs, min_sites=40).collect()}
    for i, text, _ in rows:
        assert got[i]["n_lines_removed"] == (i < 40 or 200 <= i < 500)
        assert got[i]["text"] == (text.split("\n")[0] if i < 40 or 200 <= i < 500 else text)
    assert all(r["n_lines_removed"] == 1 for r in line_dedup.strip_boilerplate(docs).collect())


def test_a_text_copied_whole_to_many_sites(spark):
    """Distinct sites decide; whole copies count for one site only where that is asked for."""
    rows = [(k, "all rights reserved by the owners", f"s{k}") for k in range(40)] + [(100 + k, "four sites have this line", f"s{k % 4}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for once, gone in ((False, 40), (True, 0)):
        got = line_dedup.strip_boilerplate(docs, copies_once=once).collect()
        assert sum(r["n_lines_removed"] for r in got if r["doc_id"] < 100) == gone and not any(r["n_lines_removed"] for r in got if r["doc_id"] >= 100)


def test_short_items_leak_with_substitutions(spark):
    item = lambda i, n: [f"i{i}w{k}" for k in range(n)]
    swap = lambda i, n, *at: " ".join(f"x{k}" if k in at else w for k, w in enumerate(item(i, n)))
    bench = spark.createDataFrame([(i, " ".join(item(i, n))) for i, n in ((1, 12), (2, 15), (3, 6), (4, 4), (5, 10), (6, 24))], "item_id long, text string")
    rows = [
        (1, swap(1, 12, 6), 1), (2, swap(2, 15, 5, 10), 2), (3, swap(3, 6, 3), 3), (4, swap(4, 4), 4), (5, swap(5, 10, 3, 6), 5), (6, swap(6, 24, 4, 9, 14, 19), 6),
        (10, swap(3, 6, 1, 4), None), (11, swap(4, 4, 3), None), (12, swap(5, 10, 2, 5, 8), None), (13, " ".join(item(1, 12)[:9]), None),
    ]
    docs = spark.createDataFrame([(i, f"before it {t} and after it") for i, t, _ in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["best_item"] for r in decontamination.report(docs, bench).collect()}
    assert got == {i: b for i, _, b in rows}


def test_recall_with_substituted_words(spark):
    """Items of 15 to 80 words in which none, one and two of ten words are replaced at random places."""
    rng = np.random.default_rng(21)
    items = [[f"i{i}w{k}" for k in range(int(rng.integers(15, 81)))] for i in range(120)]
    rows = []
    for i, words in enumerate(items):
        for tenths in (0, 1, 2):
            gone = rng.choice(len(words), len(words) * tenths // 10, replace=False)
            rows.append((10 * i + tenths, " ".join([f"d{i}x{k}" for k in range(30)] + [f"x{k}" if k in gone else w for k, w in enumerate(words)] + ["and", "more"])))
        rows.append((10 * i + 9, " ".join(f"clean{k}" for k in rng.integers(0, 10**6, 60))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: r["best_item"] for r in decontamination.report(docs, bench).collect()}
    found = [sum(got[10 * i + t] == i for i in range(120)) for t in (0, 1, 2)]
    assert found[0] == found[1] == 120 and found[2] >= 0.9 * 120
    assert not any(got[10 * i + 9] is not None for i in range(120))


def test_items_without_id_and_of_one_or_two_words(spark):
    bench = spark.createDataFrame(
        [(None, "an item without any id that has a dozen words or so here"), (None, "another one without an id and with other words than that one"), (1, "Paris"), (2, "two words"), (3, "Paris"), (4, None)],
        "item_id long, text string",
    )
    rows = [(1, "so an item without any id that has a dozen words or so here"), (2, "paris!"), (3, "in Paris there"), (4, "two words"), (5, "only two words"), (6, ""), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["leaked"], r["n_items"], r["best_item"]) for r in decontamination.report(docs, bench).collect()}
    no = (False, 0, None)
    assert got == {1: (True, 1, None), 2: (True, 2, 1), 3: no, 4: (True, 1, 2), 5: no, 6: no, 7: no}
    assert {r["doc_id"] for r in decontamination.drop_leaked(docs, bench).collect()} == {3, 5, 6, 7}


def test_verdicts_on_linked_hosts(spark):
    """All of judge on pages with hyperlinks between hosts, against plain Python."""
    rng = np.random.default_rng(31)
    hosts = ["good.org", "a.net", "b.net", "c.net", "d.net", "shop.com", "e.net", "f.net", "www.f.net", "x.www.f.net", "lonely.net"]
    rows, edges, seeds = [], {}, {}
    for k in range(160):
        host = hosts[int(rng.integers(0, len(hosts)))]
        path = {"good.org": "/", "shop.com": ("/de/", "/fr/", "/x/")[int(rng.integers(0, 3))]}.get(host, "/p")
        # a to d link among themselves and to good.org, e and f to shop.com, nobody to lonely.net
        to = {"a.net": ["good.org", "b.net"], "b.net": ["c.net"], "good.org": ["a.net", "d.net"], "e.net": ["shop.com"], "f.net": ["e.net", "shop.com"]}.get(host, [])
        to = [t for t in to if rng.random() < 0.8]
        rows.append((k, f"https://{host}{path}{k}", "".join(f'<a href="http://{t}/{k}">x</a>' for t in to)))
        for t in to:
            edges[host, t] = edges.get((host, t), 0) + 1
        rule = {"good.org": "allow", "shop.com": {"/de/": "block", "/fr/": "allow"}.get(path)}.get(host)
        if rule:
            seeds[rule, host] = seeds.get((rule, host), 0) + 1
    linked = {h for e in edges for h in e}
    for child, parent in (("www.f.net", None), ("x.www.f.net", "www.f.net")):
        if parent and any(h in url for _, url, _ in rows for h in (f"//{child}/",)):
            edges[child, parent] = edges.get((child, parent), 0) + 1
            edges[parent, child] = edges.get((parent, child), 0) + 1
    total, score = sum(seeds.values()), {}
    for kind, verdict in (("t", "allow"), ("d", "block")):
        flow = {(s, t) if kind == "t" else (t, s): w for (s, t), w in edges.items()}
        out, seed = {}, {h: n / total for (v, h), n in seeds.items() if v == verdict}
        for (s, _), w in flow.items():
            out[s] = out.get(s, 0) + w
        now = dict(seed)
        for _ in range(300):
            then = {}
            for (s, t), w in flow.items():
                then[t] = then.get(t, 0) + 0.85 * now.get(s, 0) * w / out[s]
            back = 1 - sum(then.values()) / sum(seed.values())
            now = {h: then.get(h, 0) + back * seed.get(h, 0) for h in then | seed}
        score[kind] = now
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    blocked = 0
    for k, url, _ in rows:
        host, _, path = url.removeprefix("https://").partition("/")
        t, d = score["t"].get(host, 0), score["d"].get(host, 0)
        assert (got[k]["trust"], got[k]["distrust"]) == (pytest.approx(t, abs=1e-3), pytest.approx(d, abs=1e-3))
        rule = "allow" if host == "good.org" else {"de": "block", "fr": "allow"}.get(path[:2]) if host == "shop.com" else None
        method = "block" if t + d and d / (t + d) > url_filter.BLOCK_SHARE else "allow"
        assert got[k]["verdict"] == (rule or method)
        assert got[k]["edge_source"] == ("links" if host in linked else "domains" if host.endswith("www.f.net") else None)
        blocked += rule is None and method == "block"
    assert blocked > 10
