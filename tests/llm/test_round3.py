"""The operators on private data, whitening and repair; line labels; queries and stages on small and hostile inputs."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from shiftlens.llm import neardup, private, quality, queries, repair, secrets, urls, whitening

SF = "/root/testdata/sf0.001"


def spans_by_definition(t):
    """The base spans by the plain patterns."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m.group())
        total = sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_by_definition():
    rng = random.Random(4)
    parts = ["1", "2", "0", " ", "-", ".", "+1", "4539578763621486", "255", "(", "@a.b", "x", "é", "%"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(16)))
        assert private.base_spans(t) == spans_by_definition(t), t


def test_base_spans_take_time_in_proportion():
    for t in ("x" * 400_000, "1" * 400_000, "1." * 200_000, "+1 " * 150_000, "a@" * 200_000, " " * 400_000 + "1"):
        private.occurrences(t)


def people(n=60):
    """Emails and numbers behind the same words; half of the numbers have no valid check digit."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        body = f"4539{rng.randrange(10**11):011d}"
        card = next(body + str(c) for c in range(10) if private.luhn(body + str(c))) if i % 2 else f"91{rng.randrange(10**12):012d}02"
        words = " ".join(rng.choice(["tree", "river", "stone", "cloud"]) for _ in range(5))
        rows.append((i, f"{words} reach me at name{i}@mail.example.com today. {words} account holder number {card} thanks {words} in year 199{i % 10} of"))
    return rows


def test_private_data(spark):
    schema = "doc_id long, text string, digest int, spans string, instance string"
    rows = [(*r, 1, "s", "i") for r in people()]
    rows += [(500, None, 1, "", ""), (501, "", 1, "", ""), (502, "no digits", 1, "", ""), (None, "a@b.cd", 1, "", ""), rows[3]]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    got = private.find_private(docs).collect()
    assert len(got) == len(rows) - 1
    texts = {r[0]: r[1] or "" for r in rows}
    unseen = 0
    for r in got:
        base = private.joined(spans_by_definition(texts[r.doc_id]))
        own = [s for s in r.spans.split(",") if s and not s.startswith("context")]
        assert ",".join(own) == base and r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        starts = [int(s.split(":")[1]) for s in r.spans.split(",") if s]
        assert starts == sorted(starts)
        for s in r.spans.split(","):
            if s.startswith("context"):
                a, b = map(int, s.split(":")[1:])
                assert re.fullmatch("91[0-9]{14}", texts[r.doc_id][a:b])
                unseen += 1
    wanted = sum(1 for i, t in texts.items() if re.search("number 91[0-9]{14}", t) and not any(k == 2 for _, k, _ in spans_by_definition(t)))
    assert unseen == wanted > 20
    clean = {r.doc_id: r.text for r in private.redact_private(docs).collect()}
    assert clean[500] is None and "@" not in clean[1] and "[EMAIL]" in clean[1] and not re.search("[0-9]{14}", " ".join(filter(None, clean.values())))
    empty = spark.createDataFrame([], schema)
    assert private.find_private(empty).count() == 0 and private.redact_private(empty).count() == 0


def test_patterns_are_scored_as_stated(spark):
    """Rounds over a small graph by hand."""
    edges = [("p", "a", True), ("p", "b", True), ("p", "c", False), ("q", "c", False), ("q", "d", False)]
    patterns, beliefs = private.score(spark.createDataFrame(edges, "pattern string, instance string, seed boolean"), 2)
    belief = {"a": 1.0, "b": 1.0, "c": 0.0, "d": 0.0}
    for _ in range(2):
        members = {p: [i for x, i, _ in edges if x == p] for p in "pq"}
        confidence = {p: sum(belief[i] for i in m) / (len(m) + 0.5) for p, m in members.items()}
        weight = {p: np.log2(len(m)) for p, m in members.items()}
        for i in "cd":
            own = [p for p in "pq" if i in members[p]]
            belief[i] = sum(weight[p] * confidence[p] for p in own) / sum(weight[p] for p in own)
    assert {r.pattern: round(r.confidence, 9) for r in patterns.collect()} == {p: round(c, 9) for p, c in confidence.items()}
    assert {r.instance: round(r.belief, 9) for r in beliefs.collect()} == {i: round(b, 9) for i, b in belief.items()}


def whitened_plainly(vectors):
    x = np.floor(1024 * np.array(vectors)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    y = x - s / n
    values, parts = np.linalg.eigh(y.T @ y / n)
    return ((n * x - s) ** 2).sum(1), values[::-1], y @ parts[:, ::-1]


def test_whitening(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(0, 1, (90, 5)) @ rng.normal(0, 1, (5, 5))
    vectors = [[float(np.float32(v)) for v in r] for r in base]
    vectors += [vectors[0]] * 3  # repeated rows
    rows = [(i, v, 0, 0.5) for i, v in enumerate(vectors)]
    rows += [(900, None, 1, 0.0), (901, [], 1, 0.0), (902, [1.0, None, 2.0, 3.0, 4.0], 1, 0.0), (903, [1.0, float("nan"), 2.0, 3.0, 4.0], 1, 0.0)]
    rows += [(904, [float("inf")] * 5, 1, 0.0), (905, [1.0, 2.0], 1, 0.0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, whitened double").repartition(3)
    got = whitening.whiten(table).collect()
    deviation, values, turned = whitened_plainly(vectors)
    assert len(got) == 5 * len(vectors)
    for k in range(5):
        own = sorted((r for r in got if r.component == k + 1), key=lambda r: r.vec_id)
        want = turned[:, k] / np.sqrt(values[k])
        have = np.array([r.whitened for r in own])
        assert np.abs(have - np.sign(have @ want) * want).max() < 1e-9
        assert [r.deviation for r in own] == deviation.tolist() and own[0].n == len(vectors)
        assert abs(own[0].explained / (values[k] / values.sum()) - 1) < 1e-9 and own[0].identity_error < 1e-9
    assert whitening.whiten(table.where("vec_id >= 900 and vec_id < 905")).count() == 0
    assert whitening.whiten(table.limit(0)).count() == 0
    assert whitening.whiten(table.where("vec_id = 0")).count() == 0  # one vector has no spread


def test_whitening_of_equal_and_zero_eigenvalues(spark):
    """A cross has three equal axes and two without spread: an orthonormal basis, and no component of zero."""
    corners = [[s * (k == j) / 1024 for j in range(5)] for k in range(3) for s in (-8.0, 8.0)]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(corners)], "vec_id long, embedding array<double>")
    model, _ = whitening.fit(table, 8)
    assert len(model.values) == 3 and np.allclose(model.values, 64 / 3, rtol=1e-15)
    assert np.abs(model.components @ model.components.T - np.eye(3)).max() < 1e-15
    assert np.abs(model.components[:, 3:]).max() < 1e-15


@pytest.mark.parametrize("d", [1, 2, 4, 9])
def test_characteristic_polynomial(spark, d):
    rng = np.random.default_rng(d)
    a = rng.integers(-50, 50, (d, d + 1))
    m = a @ a.T
    got = whitening.characteristic_polynomial(spark, m.tolist())
    for x in (-3, 0, 1, 17):  # det(x - m), by fractions
        from fractions import Fraction

        b = [[Fraction(int(x * (i == j) - m[i, j])) for j in range(d)] for i in range(d)]
        det = Fraction(1)
        for k in range(d):
            pivot = next((i for i in range(k, d) if b[i][k]), None)
            if pivot is None:
                det = Fraction(0)
                break
            if pivot != k:
                b[k], b[pivot], det = b[pivot], b[k], -det
            det *= b[k][k]
            for i in range(k + 1, d):
                f = b[i][k] / b[k][k]
                b[i] = [u - f * v for u, v in zip(b[i], b[k])]
        assert sum(c * x**k for k, c in enumerate(got)) == det


def audit_by_all_paths(codes):
    """Cost and audit of the cheapest edits, by keeping every audit of every state."""

    def inserted(states):
        out, level = {s: set(v) for s, v in states.items()}, states
        for _ in range(2):
            following = {s: set() for s in range(4)}
            for s, ways in level.items():
                following[repair.NEXT[s][0]] |= {(c + 5, a + "I") for c, a in ways}
            for s in out:
                out[s] |= following[s]
            level = following
        return out

    states = {0: {(0, "")}, 1: set(), 2: set(), 3: set()}
    for code in codes:
        role, fault = "sua?"[code // 4], code % 4
        after = {s: set() for s in range(4)}
        for s, ways in inserted(states).items():
            for c, a in ways:
                after[s].add((c + 2, a + "D"))
                if fault not in (1, 2):
                    more = 5 * (fault == 3)
                    kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role, s))
                    if kept is not None:
                        after[kept].add((c + more, a + "K"))
                    after[repair.NEXT[s][0]].add((c + 1 + more, a + "R"))
        states = after
    states = inserted(states)
    return min(states[0] | states[3])


def test_cheapest_audits_against_all_paths():
    rng = random.Random(1)
    for n in range(5):
        for _ in range(200 if n < 4 else 80):
            codes = bytes(rng.randrange(16) for _ in range(n))
            assert repair._audit(codes) == audit_by_all_paths(codes), codes


def test_a_long_conversation_costs_what_a_table_of_all_states_says():
    rng = random.Random(3)
    codes = bytes(rng.choice([4, 8, 4, 8, 7, 5, 10, 12]) for _ in range(3000))
    cost, audit = repair.cheapest_audit(codes)
    state = at = 0
    for code in codes:
        state, at, _ = repair.edits(state, audit, at, "sua?"[code // 4])
    state, at, _ = repair.edits(state, audit, at, None)
    assert at == len(audit) and state in (0, 3)
    ends = repair._forward(codes, 0, len(codes), 0)
    assert cost == min(c + 5 * len(repair.ENDING[s]) for s, (c, _) in enumerate(ends))


def test_repair(spark):
    rows = [
        (1, 0, "user", "Hello."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 3, "user", "cut"), (1, 4, "user", "Done!"),
        (2, None, "assistant", "  "), (2, 5, None, None), (None, 1, "system", "Be kind."), (None, 2, "user", "So?"), (3, 7, "user", "é?  \n"),
    ]
    turns = spark.createDataFrame([(*r, 9, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, code string").repartition(3)
    got = {r.conv_id: r for r in repair.repair(turns).collect()}
    one = got[1]
    assert (one.gaps, one.blank, one.duplicate, one.truncated, one.illegal) == (1, 0, 1, 1, 2)
    # user, assistant, copy away, cut turn away, then the last user's turn: delete it or answer it
    assert (one.audit, one.cost) == ("KKDDD", 6)
    assert one.repaired_sha256 == hashlib.sha256(b"user:Hello.\nassistant:Yes.").hexdigest()
    assert (got[2].blank, got[2].audit, got[2].cost, got[2].gaps) == (2, "DD", 4, 0)
    assert (got[None].audit, got[None].cost) == ("RR", 2) and got[3].audit == "D" and got[3].truncated == 0
    kept = repair.repaired_turns(repair.normalised(turns).withColumn("there", repair.F.lit(True)), repair.audits(repair.normalised(turns).withColumn("there", repair.F.lit(True))))
    rows = [(r.conv_id, r.place, r.role, r.text) for r in kept.collect()]
    assert len(rows) == 4 and set(rows) == {(1, 0, "user", "Hello."), (1, 1, "assistant", "Yes."), (None, 0, "user", "Be kind."), (None, 1, "assistant", "So?")}
    assert repair.repair(turns.limit(0)).count() == 0


def test_conversations_that_lose_all_turns_stay(spark):
    lost = [c for c in range(2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    turns = spark.createDataFrame([(c, 0, "user", "Hello.") for c in lost], "conv_id long, turn long, role string, text string")
    got = repair.repair(repair.damage(turns)).collect()
    assert sorted(r.conv_id for r in got) == lost
    assert all((r.audit, r.cost, r.gaps, r.repaired_sha256) == ("", 0, 0, hashlib.sha256(b"").hexdigest()) for r in got)


def test_line_labels(spark):
    good = "\n".join(["The river runs down to the sea and the stones are old.", "A second line of plain prose, as long as the first one."])
    rows = [(i, good if i % 2 else "\n".join(["BUY!! NOW!! ### $$$ %%%"] * 5)) for i in range(80)] + [(900, None), (901, good + "\n$$$ ### BUY!! %%% @@@ !!!\n" + good)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int"))
    lines = quality.label_lines(docs, model).collect()
    assert len(lines) == 40 * 2 + 40 * 5 + 1 + 5
    assert all(r.good == bool(r.doc_id % 2) for r in lines if r.doc_id < 80)
    assert quality.label_lines(docs.limit(0), model).count() == 0


def test_url_filter_with_clashing_names(spark):
    captures = spark.createDataFrame([(1, "http://a.example.com/x", 5, "mine", True, "x")], "page_id long, url string, day int, host string, blocked boolean, blocked_by string")
    entries = spark.createDataFrame([("example.com", "add", 1)], "pattern string, action string, day int")
    row = urls.filter_captures(captures, entries).first()
    assert (row.host, row.blocked, row.blocked_by, row.host_, row.blocked_, row.blocked_by_) == ("a.example.com", True, "example.com", "mine", True, "x")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries(spark, name):
    found = queries.QUERIES[name](spark, SF)
    rows = found.collect()
    assert rows and "doc_id" not in found.columns or len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in ("conversations", "pages", "documents"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(queries.ORACLES[name])
        names = [d[0] for d in want.description]
        assert sorted(str(tuple(r[c] for c in names)) for r in rows) == sorted(str(tuple(r)) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_hostile_rows(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (None, "x"), (10**6 + 2, "word " * 3000), (10**6 + 2, "word " * 3000)], "doc_id long, text string")
    rows = docs.unionByName(odd, allowMissingColumns=True)
    for c in ("__score", "label", "items", "key", "component_id", "bucket", "__label", "kept"):
        rows = rows.withColumn(c, repair.F.lit(1))
    out = stage(spark, rows, SF)
    ids = [r[0] for r in out.select("doc_id").collect()]
    assert None not in ids and set(ids) <= {r[0] for r in rows.select("doc_id").collect()}
    if "n_tokens" not in out.columns:
        assert out.columns == rows.columns
    assert stage(spark, rows.limit(0), SF).count() == 0


def secrets_by_definition(text):
    """Base spans of the secret scan by the plain patterns: every match is taken in turn, those too short are dropped."""
    found = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(found)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_secret_base_spans_by_definition(spark):
    rng = random.Random(6)
    parts = ["token", "PassWord", "api_key", "apikey", "=", ":", " ", '"', "'", "abc", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é", "\n", "/", "-", "secret"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(20_000)]
    for t in made:
        assert secrets.base_spans(t) == secrets_by_definition(t), t
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    nothing = secrets.Network(np.zeros((5 * secrets.N_CLASSES, 1)), np.zeros(1), np.zeros(3), np.zeros(2), 2.0)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in secrets.find_secrets(docs, nothing).collect():
        own = secrets_by_definition(texts[r.doc_id])
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in own)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.spans == said
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in own) for x in range(3))


def test_near_duplicates_lose_no_link(spark):
    """Recall against all pairs: chains of edits around the similarity that links."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(400)]
    rows, base = [], [rng.choice(words) for _ in range(120)]
    for k in range(60):
        own = list(base) if k % 3 else [rng.choice(words) for _ in range(rng.choice([3, 30, 120]))]
        for _ in range(rng.randrange(0, 6)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(max(1, len(t.split()) - 3))} for i, t in rows}
    root = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 4, 80).collect()}
    assert len(links) > 30 and got == root


def test_near_misses_are_no_findings():
    """Near-misses of every kind, from any place of a text; none from texts of few words; a finding wins over an equal near-miss."""
    text = "government mountains wonderful 12 letters é and production settings " * 3
    kinds = {label for label, _ in secrets.near_misses(text)}
    assert kinds == set(range(secrets.NEAR, secrets.FOUND)) and all(len(w) == secrets.WIDTH for _, w in secrets.near_misses(text))
    assert secrets.near_misses("") == secrets.near_misses("one two 3 four5 ab") == [] and secrets.near_misses(text) == secrets.near_misses(text)


@pytest.fixture(scope="module")
def rates_of_kinds(spark):
    """Windows of findings of two kinds with near-misses, and the rates of each kind left out of training."""
    rng = np.random.default_rng(12)
    words = "government mountains wonderful letters production settings river stone market winter".split()
    chars = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    rows = []
    for i in range(600):
        prose = " ".join(rng.choice(words, 20))
        key = "".join(rng.choice(chars, 36))
        upper = "".join(rng.choice(chars[:26] + chars[52:], 16))
        rows.append((i, f"{prose} {'api_key=' + key if i % 3 else 'AKIA' + upper} {' '.join(rng.choice(words, 5))}"))
    docs = spark.createDataFrame(rows + [(1000, None), (1001, ""), (1000, None)], "doc_id long, text string").repartition(3)
    codes, labels = secrets.labelled_windows(docs, most=900)
    return docs, labels, {name: share for name, _, share in secrets.held_out_rates(codes, labels)}


def test_near_misses_left_out_of_training(rates_of_kinds):
    """Near-misses that the network never saw stay under the threshold."""
    docs, labels, rates = rates_of_kinds
    assert max((labels == 0).sum(), ((labels > 0) & (labels < secrets.FOUND)).sum(), (labels >= secrets.FOUND).sum()) <= 900
    assert set(rates) == set(secrets.LABELS) - {"hex"}
    assert all(rates[name] <= 0.1 for name in ("plain", "identifier", "number", "digest")), rates
    assert len(secrets.labelled_windows(docs.limit(0))[0]) == 0


@pytest.mark.xfail(reason="open: keys of a kind that training lacks stay under the threshold (share 0.0)")
def test_keys_of_a_kind_left_out_of_training(rates_of_kinds):
    assert rates_of_kinds[2]["access"] >= 0.5
