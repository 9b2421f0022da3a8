"""Fixed lists typed once more, and rules at their edges."""

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import matching as M
from quillstone.operators import scoring as S
from quillstone.operators import screening as G

GHOST = """talent community|talent pipeline|future opportunities|no immediate openings|building our team for|pool of candidates|general application|we are always looking|evergreen requisition
proactive sourcing|talent pool|ongoing recruitment|continuous hiring|we're always hiring|rolling basis|no specific opening|speculative application"""
VAGUE = """dynamic environment|motivated self-starter|fast-paced|exciting opportunity|competitive compensation|great benefits|industry leader|growing company|collaborative culture|make an impact
work hard play hard|like a family|flexible work|cutting-edge|innovative solutions|wear many hats|various duties as assigned|other duties"""
CONTEXT = """security clearance|clearance required|clearance preferred|defense contractor|government contractor|federal agency|government agency|department of defense|intelligence community|national security
classified work|classified information|homeland security|military contract|federal client|government client|ic contractor|federal government|public trust clearance|dod contract|fema funded|fema grant|fema program
government services|federal funding"""
SURE = "yes|true|1|active|current|required and active|secret|top secret|ts|ts/sci|sci|confidential|dod|interim|public trust"
NONE = "no|false|none|0||n/a|not required|not applicable|na|null"
BOUNDED = """access rest async excel fitz agile scrum lead react docker linux celery poetry jira go r c rust swift dart ruby scala bash spark kafka redis flask django spring rails vue next nest helm kong vault
sca sso mfa waf ids ips vpn tls ssl pki cve edr xdr siem soar nist rbac ldap iast rasp cvss"""


@pytest.mark.parametrize(
    ("own", "typed"),
    [(G.GHOST_PHRASES, GHOST), (G.VAGUE_PHRASES, VAGUE), (G.GOV_CONTEXT, CONTEXT), (G.SURE_CLEARANCE, SURE), (G.NO_CLEARANCE, NONE), (T.BOUNDED, BOUNDED.replace(" ", "|")), (S.DUTY_STOP_WORDS, "the|and|for|with|that|this|will|are|have|has|our|you|your|their")],
)
def test_lists(own, typed):
    want = [x for line in typed.split("\n") for x in line.split("|")]
    assert sorted(own) == sorted(want) and len(set(want)) == len(want)


def test_sizes_of_duty_kinds():
    assert [(k, w, len(s)) for k, w, s in S.DUTY_KINDS] == [("core_technical", 0.5, 65), ("implementation", 0.25, 37), ("leadership", 0.2, 28), ("domain", 0.1, 29), ("cultural", 0.1, 22)]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_tiers_have_gaps(spark):
    values = {100.0: "Strong", 80.0: "Strong", 79.95: "Minimal", 79.9: "Moderate", 50.0: "Moderate", 49.95: "Minimal", 49.9: "Weak", 25.0: "Weak", 24.9: "Minimal", 0.0: "Minimal"}
    assert list(one(spark, *(S.coverage_tier(F.lit(v)) for v in values))) == list(values.values())


def test_edges_of_words(spark):
    cases = (("nsa", "the nsa, too", True), ("nsa", "insane", False), ("nsa", "nsa_x", False), ("dod ", "dod x", True), ("dod ", "dod  x", False), ("dod ", "a dod", False), ("cia", "ñcia", False))
    assert list(one(spark, *(F.lit(t).rlike(G.edged(s)) for s, t, _ in cases))) == [w for _, _, w in cases]


def test_gate_of_the_clearance_field(spark):
    from datetime import datetime

    rows = [("required", "a military contract"), ("required", "homeland security"), ("Required and Active", "plain"), ("required", "federal express"), ("no", "a military contract"), (None, "a military contract")]
    jobs = spark.createDataFrame([(i, c, d, "Acme", "Data Engineer", "Berlin") for i, (c, d) in enumerate(rows)], "id long, clearance_required string, description string, company string, title string, location string")
    got = G.screen(jobs, G.GateConfig(datetime(2020, 1, 1)), gates=tuple(g for g in G.GATES if g[0] == "0B_defense"))
    assert {r["id"]: r["outcome"] for r in got.collect()} == {0: "fail", 1: "fail", 2: "fail", 3: "pass", 4: "pass", 5: "pass"}


def test_cleaner_at_its_edges(spark):
    cases = {"&amp;lt;b&amp;gt;": "<b>", "&quot;q&quot;": "q", "&rsquo;&mdash;&#8211;": "'—–", "a<br>b<li>c</li>d": "a\nbc\nd", "# H\n* i\n\\* j": "H\n• i\n• j", "![alt](u) [t](v)": "!alt t", "**b** __c__ `d`": "b c d", "x\n---\ny": "x\n\ny", "": ""}
    assert dict(zip(cases, one(spark, *(T.clean_description(F.lit(k)) for k in cases)))) == cases


def test_audit_of_a_letter(spark):
    letter = F.lit("I architected it: 50% in 2017, 40 hours, 3x; with Azure Functions")
    a = one(spark, M.audit(letter, F.lit("40 things, built"), F.array(F.struct(F.lit("A").alias("employer"), F.lit("2018").alias("start")))).alias("a"))["a"]
    assert (a["figures"], a["scope"], a["tools"], a["employers"], a["score"], a["passed"]) == (["50%", "3x"], [], ["azure functions"], ["A"], 100 - 45 - 7, False)
    assert one(spark, M.audit(F.lit(None).cast("string"), F.lit("x")).alias("a"))["a"]["score"] == 100


def test_repair_is_the_model(spark):
    texts = ["", "plain", "café", "日本 “q” – €", "\U0001f4c8 up", "ñandú — ¿qué?", "Привет", "Ã", "a\x9db", "Â£5 – ok", "Å“uvre", "x\u0178y"]
    broken = [t.encode().decode("latin-1") for t in texts] + [t.encode().decode("cp1252", "ignore") for t in texts] + texts + ["cafÃ© und €", "\u00f0\u0178\u00a2 sign", "\u00f0\u0178\u2018\u00a5"]

    def model(t):
        for page in ("cp1252", "latin-1"):
            try:
                t = t.encode(page).decode()
                break
            except UnicodeError:
                continue
        for a, b in T.BROKEN_SIGNS:
            t = t.replace(a, b)
        return t

    rows = spark.createDataFrame(list(enumerate(broken)), "i int, t string")
    got = {r["i"]: r["r"] for r in rows.select("i", T.repaired(F.col("t")).alias("r")).collect()}
    assert got == {i: model(t) for i, t in enumerate(broken)}
    assert sum(got[i] != broken[i] for i in got) >= 8
