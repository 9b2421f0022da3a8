"""Line by line operators against plain models that go through the lines one by one."""

import re
from html import escape

from pyspark.sql import functions as F

from quillstone.operators import lines as L
from quillstone.plans.lines import BASE, resumes, shaped, track_documents

WHERE = "/root/testdata/sf0.001"
ODD = [None, "", "\n\n", "Head\n\nitem one\n\nitem two\nnext to it\n\nlate", "A <b> & \"c\" 'd'\nlonger than the line above it", "x" * 80 + "\n" + "y" * 81, "T\n\n" + "One. " * 90 + "\n\nafter", "• dot\n\n\n• dot\n\nH\nlonger text follows here.", "Head\n\nA rather long heading of more than forty characters\n\nand a line that is longer still, by far, than that one\n\nend"]


def model(text):
    """A fold over the lines with the section's state."""
    if not text:
        return 0, 0, "No description available."
    lines, open_ = text.split("\n"), False
    s, n = [x.strip() for x in lines], text.count("\n") + 1
    kinds = ["blank"] * n
    for i in range(n):
        if not s[i]:
            continue
        after = next((x for x in s[i + 1 :] if x), None)
        short = not s[i].startswith(("•", "-", "–", "▪", "*", "►")) and len(s[i]) <= 80 and not s[i].endswith((".", ",", ";", "!", "?")) and (after is None or len(after) > len(s[i]))
        if short:
            kinds[i] = "heading" if not open_ or len(s[i]) <= 40 else "item"
            open_ = True
        elif open_ and (i == 0 or not s[i - 1]) and (i + 1 == n or not s[i + 1]) and not (len(s[i]) > 300 and s[i].count(".") > 3):
            kinds[i] = "item"
        else:
            kinds[i], open_ = "text", False
    out = []
    for i in range(n):
        if kinds[i] == "blank":
            j = next((j for j in range(i + 1, n) if s[j]), None)
            if j is not None and (kinds[j] in ("heading", "item") or s[j].startswith(("•", "–", "▪", "►"))):
                continue
        e = lambda x: escape(x).replace("&#x27;", "&#39;").replace("&quot;", "&#34;")
        out.append({"heading": f"<strong>{e(s[i])}</strong>", "item": f"  • {e(s[i])}"}.get(kinds[i], e(lines[i])))
    return kinds.count("heading"), kinds.count("item"), "\n".join(out)


def test_formatted_is_the_model(spark):
    docs = shaped(spark.read.parquet(f"{WHERE}/documents.parquet"))
    docs = docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)], "doc_id long, t string"))
    want = {r["doc_id"]: model(r["t"]) for r in docs.collect()}
    got = {r["key"]: (r["n_headings"], r["n_items"], r["html"]) for r in L.formatted(docs, "doc_id", "t").collect()}
    assert got == want and sum(w[0] for w in want.values()) > 50 and sum(w[1] for w in want.values()) > 50


def sections(text):
    names = {"summary": "summary|professional summary|objective|profile", "experience": "experience|work experience|employment|professional experience", "technical_skills": "skills|technical skills|core competencies|technologies", "education": "education|academic|degrees", "projects": "projects?|portfolio|personal projects|key projects", "certifications": "certifications?|licenses?|credentials", "awards": "awards?|honors?|achievements?"}
    out, name, own = {}, "header", []
    for line in text.split("\n"):
        hit = next((n for n, p in names.items() if re.match(f"(?i)^({p})", line.strip())), None)
        if hit:
            if own:
                out[name] = "\n".join(own)
            name, own = hit, [line]
        else:
            own.append(line)
    return out | {name: "\n".join(own)}


def cut(content):
    lines, n = content.split("\n"), 0
    out = lines[:1]
    for x in lines[1:]:
        if re.match(r"[-*•–]|\d+\.", x.strip()):
            n += 1
            out += [x] * (n <= 3)
        elif not n:
            out.append(x)
    return "\n".join(out)


def test_sections_are_the_model(spark):
    docs = resumes(spark.read.parquet(f"{WHERE}/documents.parquet").limit(60))
    docs = docs.unionByName(spark.createDataFrame([(10**6, ""), (10**6 + 1, "Skills\nSkills\nExperience\n- a\nb\n- c\n- d\n- e"), (10**6 + 2, None)], "doc_id long, t string"))
    want = {r["doc_id"]: sections(r["t"]) for r in docs.collect() if r["t"] is not None}
    got = {}
    for r in L.resume_sections(docs, "doc_id", "t").collect():
        got.setdefault(r["key"], {})[r["section"]] = r["content"]
    assert got == want
    order = ("header", "summary", "experience", "technical_skills", "projects", "education", "certifications", "awards")
    trimmed = {r["key"]: r["trimmed"] for r in L.trimmed(docs, "doc_id", "t", ("experience", "awards")).collect()}
    assert trimmed == {i: "\n\n".join(cut(p[n]) if n in ("experience", "awards") else p[n] for n in order if n in p) for i, p in want.items()}


def test_roles_are_the_model(spark):
    docs = track_documents(spark.read.parquet(f"{WHERE}/documents.parquet").limit(60))
    docs = docs.unionByName(spark.createDataFrame([(10**6, "no roles"), (10**6 + 1, "\n### X — 1 — 2\n- b"), (10**6 + 2, None)], "doc_id long, t string"))
    skip = ("programming", "cloud", "data engineering", "ai / ml", "development tools", "api &", "architecture", "compliance", "authentication", "employment structure")

    def read(text):
        for part in re.split(r"\n### ", text)[1:]:
            lines = part.split("\n")
            header, body = lines[0].lstrip("#").strip(), "\n".join(lines[1:])
            if any(k in header.lower() for k in skip):
                continue
            company, dates = (x.strip() for x in header.split("—", 1)) if "—" in header else (header, "")
            found = lambda p, flags=0: (m[1].strip() if (m := re.search(p, body, flags)) else "")  # noqa: B023, E731
            bullets = [x.strip()[2:].strip() for x in lines[1:] if x.strip().startswith("- ") and not x.strip().startswith("- *")]
            bullets = [b for b in bullets if not any(k in b.lower() for k in ("scope boundaries", "overall fastapi", "did not build", "deployments were"))]
            if company and bullets:
                yield (company, dates, found(r"\*\*(?:Title|Engineering Title):\*\*\s*(.+?)$", re.M), found(r"\*\*(.+?(?:VA|DC|MD|NY).+?)\*\*"), bullets, found(r"\*\*Engineering stack:\*\*\s*(.+?)$", re.M))

    want = {r["doc_id"]: list(read(r["t"])) for r in docs.collect() if r["t"] is not None}
    got = {r["doc_id"]: [tuple(x)[:6] for x in r["r"]] for r in docs.select("doc_id", L.roles(F.col("t")).alias("r")).collect() if r["r"] is not None}
    assert got == want


def test_fillers_are_the_model(spark):
    text = F.col("text")
    for word, by in ((" de ", " Robust "), (" the ", " dynamic "), (" la ", " cutting-edge ")):
        text = F.replace(text, F.lit(word), F.lit(by))
    docs = spark.read.parquet(f"{WHERE}/documents.parquet").select("doc_id", text.alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(10**6, "robust robust robust robust\nrobust x\nDynamic dynamic\ndynamic\tdynamic dynamic y dynamics dynamic"), (10**6 + 1, None), (10**6 + 2, "holistic\nholistic \nholistic a holistic b\n\nholistic\n")], "doc_id long, text string"))

    def strip(t):
        for word in ("analytical", "comprehensive", "systematic", "strategic", "robust", "scalable", "innovative", "cutting-edge", "dynamic", "holistic", "enterprise-grade"):
            n, lines, gone = len(re.findall(rf"\b{word}\b", t, re.I)), t.split("\n"), 0
            if n > 3 and len(re.findall(rf"\b{word}\b", BASE, re.I)) <= 1:
                for i in reversed(range(len(lines))):
                    new = re.sub(rf"\b{word}\s+", "", lines[i], count=1, flags=re.I) if gone < n - 2 else lines[i]
                    gone += new != lines[i]
                    lines[i] = new
            t = "\n".join(lines)
        return t

    want = {r["doc_id"]: None if r["text"] is None else strip(r["text"]) for r in docs.collect()}
    got = {r["doc_id"]: r["text"] for r in L.without_fillers(docs, "text", F.lit(BASE)).collect()}
    assert got == want and want != {r["doc_id"]: r["text"] for r in docs.collect()}
