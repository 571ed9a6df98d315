import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kgspark.llm import chat, decontaminate, fingerprints, licenses, nearjoin, packing, sharding, suffixtree, tokenfiles, toxicity
from kgspark.llm.common import words_of as licenses_words
from kgspark.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, row string"
LONG = " ".join(f"w{i * 7919 % 1000}" for i in range(6000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "", "en", "a"), (2, None, None, None), (3, "one two", "en", "a"), (3, "one two", "en", "a"), (4, LONG, "de", "a"), (5, LONG + " more", "de", "b"),
            (None, "null id text here now", "en", "b"), (6, "Released under the MIT License. All rights reserved.\n\n a  b", "en", "b"), (7, "Été \\ ### </turn>", "fr", "c")]
    return spark.createDataFrame([(*r, 0, 0.5, 1, "x") for r in rows], SCHEMA)


def ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_packing_keeps_every_id_once(docs):
    rows = packing.pack(docs, tokenizer(), end_id=1, length=64).collect()
    assert sum(r.length for r in rows) == sum(len(ids(r.text)) + 1 for r in docs.collect())
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, pieces in by.items():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at == 64 or k == max(by)


@pytest.mark.parametrize("targets", [None, {"a": 0.7, "b": 0.3}, {"a": 0.01, "c": 5.0, "none here": 2.0}, {packing.NULL_SOURCE: 1.0}])
def test_packing_is_deficit_round_robin(spark, targets):
    """Every piece lies where round-robin one round after another puts it; what each source has sent stays within a piece of its share."""
    import random

    deal = random.Random(3)
    rows = [(i, " ".join(f"w{deal.randrange(500)}" for _ in range(deal.choice((0, 3, 20, 60, 300)))), deal.choice(("a", "a", "a", "b", "c", None))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    got = packing.pack(docs, tokenizer(), length=64, targets=targets, quantum=16).collect()
    sizes = [(d, packing.NULL_SOURCE if s is None else s, len(ids(t)) + 1) for d, t, s in rows]
    want = packing.brute_force(sizes, 64, targets, 16)
    assert sorted((r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in got) == sorted(want)
    full = {d: [*ids(t), 1] for d, t, _ in rows}
    import numpy as np

    assert all(r.ids_crc32 == zlib.crc32(np.array(full[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(full[r.doc_id]) for r in got)
    if targets is None or len(targets) == 2:  # while all sources last, every window's start finds each within two pieces and a round of its share
        share = {q: n / sum(m for _, p, m in sizes if not targets or p in targets) for q, n in ((q, sum(m for _, p, m in sizes if p == q)) for q in {p for _, p, _ in sizes})} if not targets else targets
        left = {q: sum(m for _, p, m in sizes if p == q) for q in share}
        sent = dict.fromkeys(share, 0)
        for k in range(max(r.sequence_id for r in got)):
            here = [r for r in got if r.sequence_id == k and r.queue in share]
            for r in here:
                sent[r.queue] += r.length
            if any(sent[q] > left[q] - 64 for q in share):
                break
            assert all(abs(sent[q] - share[q] * sum(sent.values())) <= 2 * 16 * len(share) + 64 for q in share)


@pytest.mark.parametrize("targets", [{}, {"a": -1.0}, {"a": float("nan")}, {"a": 0.0}])
def test_packing_refuses_useless_targets(targets):
    with pytest.raises(ValueError):
        packing.checked(targets)


def test_token_files_round_trip(docs):
    got = tokenfiles.read_documents(tokenfiles.write_token_files(docs, tokenizer(), 2)).collect()
    import numpy as np

    want = sorted((zlib.crc32(np.array(ids(r.text) + [2], "<u4").tobytes()), len(ids(r.text)) + 1) for r in docs.collect())
    assert sorted((r.ids_crc32, r.n_tokens) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_sharding_is_even_and_gapless(docs):
    rows = sharding.stratified_shards(docs, 4).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 9 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding_does_not_depend_on_blocks(docs, monkeypatch):
    want = sorted(sharding.stratified_shards(docs, 4).collect(), key=repr)
    monkeypatch.setattr(sharding, "LEAST_BITS", 1)
    few = sorted(sharding.stratified_shards(docs, 4).collect(), key=repr)
    monkeypatch.setattr(sharding, "ROWS_A_BLOCK", 1)
    monkeypatch.setattr(sharding, "LEAST_BITS", 13)
    assert want == few == sorted(sharding.stratified_shards(docs, 4).collect(), key=repr)


def test_fingerprints_follow_the_edit_rule(docs):
    rows = fingerprints.edited_fingerprints(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id}
    order = sorted(texts, reverse=True)
    for r in rows:
        t, nxt = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        cut = len(t) // 3
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert next(r.near_next for r in rows if r.doc_id == 5) > 0.9


def test_license_labels(docs):
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert (got[6].base_labels, got[6].labels, got[6].n_base, got[6].first_word) == ("reserved", "mit,reserved", 1, 5)
    assert got[1].n_words == 0 and got[2].labels == ""


def matching(rx):
    """Texts that an expression matches: every alternative, with and without each optional part."""
    import re

    def each(op, arg):
        if op == "LITERAL":
            return [chr(arg)]
        if op == "IN":
            return ["1" if "DIGIT" in str(v) else "w" if str(k) == "CATEGORY" else chr(v) for k, v in arg if str(k) != "RANGE"] + [chr(v[0]) for k, v in arg if str(k) == "RANGE"]
        if op == "SUBPATTERN":
            return every(arg[3])
        if op == "BRANCH":
            return [x for b in arg[1] for x in every(b)]
        least, most, body = arg
        return [x for n in sorted({least, min(most, least + 1)}) for x in every(list(body) * n)]

    def every(items):
        out = [""]
        for op, arg in items:
            out = [o + x for o in out for x in each(str(op), arg)]
        return out

    return sorted({x for x in every(re._parser.parse(rx)) if re.fullmatch(r"\w+(?: \w+)*", x)})  # others are no normalised texts


def test_every_license_rule_is_detected_alone(spark):
    assert sum(kind != "grant" for *_, kind in licenses.rules()) >= 200
    rows = [(n, p, label, text) for n, (label, p, _, rx, kind) in enumerate(licenses.rules()) if kind != "grant" for text in matching(rx)]
    docs = spark.createDataFrame([(i, r[3]) for i, r in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.found for r in licenses.detections(docs).select("doc_id", "found").collect()}
    # An equal or longer span of another rule may stand in its place, but the whole text is always covered.
    lost = [r for i, r in enumerate(rows) if not any(d.start <= 1 and d.stop >= len(r[3]) + 1 for d in got[i])]
    assert lost == []


LICENSED = {
    "gpl v3": "gpl-3.0", "GNU GPL v3": "gpl-3.0", "gnu fdl": "gfdl", "library general public license 2": "lgpl-2.1", "freebsd license": "bsd-2-clause", "0bsd": "0bsd", "ASL 2.0": "apache-2.0",
    "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0", "SPDX-License-Identifier: CC-BY-NC-SA-4.0": "cc-by-nc-sa-4.0", "spdx-license-identifier: apache-2.0": "apache-2.0",
    "Licensed under the MIT": "mit", "distributed under the GPL": "gpl", "It is licensed under AGPL.": "agpl", "released under gpl2": "gpl-2.0", "gpl2": "gpl-2.0", "GPLv3 or later": "gpl-3.0", "the Apache License, Version 2.0": "apache-2.0",
    "available under the terms of the artistic license": "artistic-1.0", "Perl Artistic License": "artistic-1.0", "lgpl 2.1": "lgpl-2.1", "dual licensed under Apache 2.0": "apache-2.0", "may not be used to train models": "no-training",
    "published under the BSD license": "bsd", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International": "cc-by-nc-sa",
}
UNLICENSED = """Smith et al. 2 report this. Kim et al., 2.0 mm wide. The artistic license taken by the painter was wide. She drove under a provisional licence. MIT is a school in Cambridge.
The apache helicopter has 2 engines. Apache 2 of 3 crews returned. A general public enquiry was held. His driving license expired in May. They licensed the song to a film. The boost was 1.0 bar. Provided by Apache crews at dawn.
We met Ms. Plum at noon. Ms. Rlang spoke next. The public was in a domain of its own. Poetic license is a freedom. They train for research and sports. The server side of the house is public. The mozilla mascot is a lizard.
An eclipse is a public event. Section 3.0 of the plan. The bsd meeting had 3 points. Route 66 was released by the authority. Isc is a short word. A zebra of 4 stripes. The rights of all were respected. He reserved a table for two.
The common public likes bread. Free documentation is on the shelf. The elastic band broke twice. Python eats mice at night. Ruby is a red stone. The font of the chapel is open. Commons debated attribution of blame. The oak was blue in the dusk.
Copyright is a hard subject. The trademark of his style is speed. Their warranty lasts two years. Permission was granted by the mayor. Redistribution of wealth was discussed. The written permission arrived late. Commercial use of water grew.
The vim of the young is strong. Latex paint dries fast. The llama grazes in Peru. Universal education is permissive of play. Academic work is not free. The business has one source of income. A lesser library in general is public. He was unauthorized to speak.
Evaluation takes time. The product includes a manual. See the file for the plan. They are distributed under the bridge. It was published under the name of another. Goods are offered under the counter. All available under one roof. Released under pressure."""


def test_licences_that_are_named_and_sentences_without_one(spark):
    none = [s.strip() for s in UNLICENSED.replace("\n", " ").split(". ")]
    assert len(none) >= 50
    docs = spark.createDataFrame(list(enumerate([*LICENSED, *none])), "doc_id long, text string")
    labels = {r.doc_id: r.labels for r in licenses.license_scan(docs).collect()}
    assert {t: labels[i] for i, (t, want) in enumerate(LICENSED.items()) if want not in labels[i].split(",")} == {}
    assert {t: labels[i + len(LICENSED)] for i, t in enumerate(none) if labels[i + len(LICENSED)]} == {}


def test_overlaps_are_suppressed_as_by_all_pairs(spark):
    """Of all matches of all rules the ones stay that lie inside no other of equal or higher priority (the same span: of a higher one, or an earlier rule), nor inside one of a full name or grant."""
    import re

    texts = ["Licensed under the GNU General Public License version 2 or later. All rights reserved, see the license file for details.", "SPDX-License-Identifier: GPL-2.0-or-later and gpl 2.0",
             "released under the terms of the apache license 2.0 copyright 2020 2021 all rights strictly reserved worldwide", "creative commons attribution share alike 4 0 cc by sa 4.0 cc by", "mit license mit license mit x11 license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {(d.start, d.stop, d.n) for d in r.found} for r in licenses.detections(docs).select("doc_id", "found").collect()}
    table = [(i, p, set(keys.split(" ")), re.compile(rf"(?<= )(?:{rx})(?= )")) for i, (_, p, keys, rx, _) in enumerate(licenses.rules())]
    for k, text in enumerate(texts):
        norm = " " + b" ".join(licenses_words(text)).decode() + " "
        every = [(m.start(), m.end(), p, i) for i, p, keys, rx in table if keys & set(norm.split()) for m in rx.finditer(norm)]
        inside = lambda d, o: o[0] <= d[0] and d[1] <= o[1] and o != d
        beats = lambda o, d: (o[:2] != d[:2] and (o[2] >= d[2] or o[2] >= 3)) or (o[:2] == d[:2] and (o[2] > d[2] or (o[2] == d[2] and o[3] < d[3])))
        assert got[k] == {(d[0], d[1], d[3]) for d in every if not any(inside(d, o) and beats(o, d) for o in every)}


def test_decontamination_equals_brute_force(spark, docs):
    bench = spark.createDataFrame([(1, " ".join(LONG.split()[50:70])), (2, "one TWO"), (3, None), (4, "not there at all")], "item_id long, text string")
    items = [(str(r.item_id), r.text) for r in bench.collect()]
    for r in decontaminate.contamination(docs, bench).collect():
        texts = {x.doc_id: x.text for x in docs.collect()}
        assert (r.n_words, r.n_hit, r.n_items) == (lambda b: (b[0], b[1], len(b[2])))(decontaminate.brute_force(texts[r.doc_id], items))
    assert set(decontaminate.decontaminated(docs, bench).columns) == set(docs.columns)


def test_near_join_equals_brute_force(docs):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    want = nearjoin.brute_force({r.doc_id: r.text for r in rows.collect()})
    for limit in (3000, 2):
        got = nearjoin.classes(rows, limit=limit).collect()
        assert {r.doc_id: r.n_links for r in got} == {k: len(v) for k, v in want.items()}
    assert nearjoin.deduplicated(docs).count() == 6  # 1 and 2 empty, 3 twice, 4 and 5 near


def test_suffix_tree_scores_every_row(docs):
    rows = suffixtree.scores(docs, F.lit(False)).collect()
    assert len(rows) == 9 and all(r.n_known == r.n_tokens and r.score < 0 for r in rows)
    assert suffixtree.scores(docs, F.lit(True)).first().train_tokens == 0


def suffix_tree_brute_force(texts, held_out):
    """Scores by a tree in dictionaries, whatever share of the corpus a context has."""
    from math import log, log10

    import numpy as np

    size, nxt = suffixtree.DEPTH, []
    k, n = np.unique(suffixtree.grams(texts)[0], return_counts=True)
    for d in range(size + 1):
        level = {}
        for key, c in zip(k.tolist(), n.tolist()):
            key &= (1 << 8 * (d + 1)) - 1
            at = level.setdefault(key >> 8, {})
            at[key & 255] = at.get(key & 255, 0) + c
        nxt.append(level)
    keep = [{0}] + [set() for _ in range(size)]
    for d in range(size, 0, -1):
        for ctx, at in nxt[d].items():
            low, total = nxt[d - 1][ctx & (1 << 8 * (d - 1)) - 1], sum(at.values())
            if total >= 2 and sum(c * log(c / total * sum(low.values()) / low[s]) for s, c in at.items()) > suffixtree.DIVERGENCE:
                keep[d].add(ctx)
        if d > 1:
            keep[d - 1] |= {c & (1 << 8 * (d - 1)) - 1 for c in keep[d]}

    def p(key, d):
        if d < 0:
            return 1 / 256
        low = p(key & (1 << 8 * d) - 1, d - 1) if d else 1 / 256
        if key >> 8 not in keep[d]:
            return low
        at = nxt[d][key >> 8]
        return (at.get(key & 255, 0) + len(at) * low) / (sum(at.values()) + len(at))

    words = Counter(w for t in texts for w in [*t.split(), suffixtree.END])
    total = sum(words.values())
    e, unknown = suffixtree.escape(total, *(sum(c == k for c in words.values()) for k in (1, 2)))

    def score(t):
        at, got, keys = 0, 0.0, suffixtree.grams([t])[0].tolist()
        own = t.split()
        for i, w in enumerate([*own, suffixtree.END]):
            n = 1 if i == len(own) else len(w) + (i < len(own) - 1)
            spelt = 10 ** sum(log10(p(key, size)) for key in keys[at : at + n])
            at += n
            got += log10((1 - e) * (suffixtree.TREE * spelt + (1 - suffixtree.TREE) * words[w] / total)) if words[w] else unknown
        return got

    return [score(t) for t in held_out]


@pytest.mark.parametrize("fans", [nearjoin.FANS, (2.0, 1.0, 1.0)])  # with the second, a third of the sets of a split bucket follow no token there
def test_near_join_keeps_every_link_of_large_groups(spark, fans):
    import random

    deal = random.Random(5)
    shared = [f"s{i}" for i in range(200)]
    texts = {}
    for i in range(120):  # near copies of one text, each with some words of its own
        words = list(shared)
        for k in deal.sample(range(200), deal.choice((1, 2, 3))):
            words[k] = f"x{i}y{k}"
        texts[i] = " ".join(words)
    for i in range(120, 240):  # a passage in common, else different
        texts[i] = " ".join([*shared[:12], *(f"z{i}q{k}" for k in range(60))])
    want = nearjoin.brute_force(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = nearjoin.signed(docs, fans=fans)
    for limit in (20, 100):
        reps, found = nearjoin.links(rows, limit=limit, fans=fans)
        got = {r.first: r.n for r in reps.join(found.groupBy("skey").agg(F.sum("links").alias("n")), "skey").collect()}
        assert got == {k: len(v) for k, v in want.items() if v}


@pytest.mark.parametrize("most", [2_000_000, 8])
def test_suffix_tree_keeps_rare_contexts_of_large_corpora(spark, monkeypatch, most):
    rare, held = [b"zqxjk vwpgh"] * 20, [b"zqxjk vwpgh", b"ab zqxjk \xc3\xa9", b""]
    texts = [b"ab " * 1_000_000 + b"ab", *rare]  # each rare context holds less than 1e-5 of the symbols
    rows = [(i, t.decode(), False) for i, t in enumerate(texts)] + [(100 + i, t.decode(), True) for i, t in enumerate(held)]
    monkeypatch.setattr(suffixtree, "GRAMS", most, raising=False)
    got = {r.doc_id: r.score for r in suffixtree.scores(spark.createDataFrame(rows, "doc_id long, text string, out boolean"), F.col("out")).collect()}
    want = suffix_tree_brute_force(texts, [*held, rare[0]])
    assert [got[100], got[101], got[102], got[1]] == pytest.approx(want, rel=1e-9)


def test_toxicity_learns_a_word(spark):
    rows = [(i, "fine plain words here" + (" nasty" if i % 2 else "") + f" x{i}", "en") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels, F.col("doc_id") % 5 == 0).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)
    assert toxicity.toxicity(docs, labels.limit(0), F.lit(False)).agg(F.max("score")).first()[0] == 0


def test_chat_fold_and_round_trip(spark):
    e = spark.createDataFrame([(1, 1, "message", "a", "user", "hi"), (1, 2, "message", "b", "assistant", ""), (1, 3, "delta", "b", None, "x"), (1, 4, "message", "c", "user", "more"),
                               (1, 5, "regenerate", "b", None, None), (1, 6, "delta", "b", None, "y </turn>"), (1, 7, "edit", "a", None, "\\### hello")], "conv_id long, seq long, kind string, msg_id string, role string, text string")
    out = chat.rendered(chat.folded(e)).orderBy("at").collect()
    assert [chat.parsed(r.formatted) for r in out] == [("user", "\\### hello"), ("assistant", "y </turn>")]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (packing.pack(none, tokenizer()), sharding.stratified_shards(none), fingerprints.edited_fingerprints(none), licenses.license_scan(none), decontaminate.contamination(none, bench),
               nearjoin.classes(none), suffixtree.scores(none, F.lit(False)), tokenfiles.read_documents(tokenfiles.write_token_files(none, tokenizer(), 2))):
        assert df.count() == 0
