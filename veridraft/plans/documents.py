"""Registered queries: paragraphs, claim matching, heatmap, canonical text, claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridraft.operators import canonical as K
from veridraft.operators import paragraphs as P
from veridraft.operators.triage import pick_flag
from veridraft.plans.registry import query
from veridraft.plans.triage import SELECTION_SQL, selection

C = F.col
MATCHING = ("v_doc_flags", "v_paragraphs", "v_matches")
FIRST_LINE = "flag_id = concat_ws('-', doc_id, 1)"


def _paragraphs(v):
    return P.paragraphs(v.table("documents"), "doc_id", "text", "\n")


def _matches(v, **kw):
    return P.match_paragraphs(_paragraphs(v), v.doc_flags(), "doc_id", **kw)


@query("a56_match_paragraphs", "SELECT doc_id, para_no, flag_id FROM v_matches", MATCHING)
def _(v):
    return _matches(v)


@query("a56_match_many_flags", "SELECT doc_id, para_no, flag_id FROM v_matches", MATCHING)
def _(v):
    # the path for audits with very many flags, forced for all of them
    return _matches(v, small=0)


@query("a57_split_paragraphs", "SELECT doc_id, para_no, para FROM v_paragraphs", ("v_paragraphs",))
def _(v):
    return _paragraphs(v)


@query(
    "a58_clean_paragraphs",
    """SELECT p.doc_id, p.para_no, p.para FROM v_paragraphs p
       WHERE NOT EXISTS (SELECT 1 FROM v_doc_flags f WHERE f.doc_id = p.doc_id AND f.status = 'PENDING'
         AND contains(lower(p.para), substr(lower(f.claim), 1, 30)))""",
    MATCHING,
)
def _(v):
    # every line has a flag; every other one is pending
    pending = P.match_paragraphs(_paragraphs(v), v.doc_flags().where("status = 'PENDING'"), "doc_id")
    return P.clean_paragraphs(_paragraphs(v), pending, "doc_id")


REST_SQL = r"""regexp_replace(CASE WHEN m.flag_id IS NULL THEN p.para WHEN strpos(p.para, f.claim) = 0 THEN p.para
   ELSE concat(substr(p.para, 1, strpos(p.para, f.claim) - 1), substr(p.para, strpos(p.para, f.claim) + length(f.claim))) END, '^\s+|\s+$', '', 'g')"""


@query(
    "a59_paragraph_remainder",
    f"""SELECT p.doc_id, p.para_no, {REST_SQL} AS remainder FROM v_paragraphs p
        JOIN v_matches m ON p.doc_id = m.doc_id AND p.para_no = m.para_no
        JOIN v_doc_flags f ON m.doc_id = f.doc_id AND m.flag_id = f.flag_id""",
    MATCHING,
)
def _(v):
    view = P.paragraph_view(_paragraphs(v), _matches(v), v.doc_flags(), key="doc_id")
    return view.where("NOT is_clean").select("doc_id", "para_no", C("shown_text").alias("remainder"))


@query(
    "a60_paragraph_view",
    """SELECT p.doc_id, p.para_no, m.flag_id, m.flag_id IS NULL AS is_clean,
       coalesce(f.status = 'PENDING' OR f.severity = 'LOW', TRUE) AS is_visible,
       coalesce(m.flag_id = concat(p.doc_id, '-1'), FALSE) AS is_selected
       FROM v_paragraphs p LEFT JOIN v_matches m ON p.doc_id = m.doc_id AND p.para_no = m.para_no
       LEFT JOIN v_doc_flags f ON m.doc_id = f.doc_id AND m.flag_id = f.flag_id""",
    MATCHING,
)
def _(v):
    flags = v.doc_flags()
    chosen = flags.where(FIRST_LINE).select("doc_id", "flag_id")
    view = P.paragraph_view(_paragraphs(v), _matches(v), flags, chosen, "UNCERTAIN", "doc_id")
    return view.select("doc_id", "para_no", "flag_id", "is_clean", "is_visible", "is_selected")


@query(
    "a61_is_dynamic",
    """SELECT d.doc_id, CASE WHEN d.lang = 'en' THEN TRUE ELSE FALSE END AND coalesce(f.claim <> '', FALSE) AS is_dynamic
       FROM documents d LEFT JOIN v_doc_flags f ON d.doc_id = f.doc_id AND f.flag_id = concat(d.doc_id, '-1')""",
    ("v_doc_flags",),
)
def _(v):
    text = F.when(C("lang") == "en", F.concat(F.lit("AI SYNTHESIZED\n"), "text")).otherwise(C("text"))
    docs = v.table("documents").select(C("doc_id").alias("audit_id"), text.alias("raw_text"))
    flags = v.doc_flags().withColumn("ord", F.when(F.expr(FIRST_LINE), 0).otherwise(1))
    return P.is_dynamic(docs, flags.withColumnRenamed("doc_id", "audit_id")).withColumnRenamed("audit_id", "doc_id")


@query(
    "a62_heatmap",
    f"""WITH {SELECTION_SQL}
       SELECT a.audit_id, CAST(s.section AS INT) AS section, f.flag_id,
         CASE WHEN f.severity IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN f.severity ELSE 'CLEAN' END AS severity,
         f.flag_id IS NULL AS is_clean, x.flag_id IS NOT NULL AS has_selected,
         CASE f.severity WHEN 'CRITICAL' THEN 'Critical Risk' WHEN 'HIGH' THEN 'High Variance' WHEN 'MEDIUM' THEN 'Review Needed' WHEN 'LOW' THEN 'Low' ELSE 'Clean' END AS label,
         CASE WHEN f.flag_id IS NULL THEN 'clean' ELSE '1 issue' END AS count_text
       FROM v_audits a CROSS JOIN range(1, 6) s(section)
       LEFT JOIN v_flags f ON a.audit_id = f.audit_id AND f.ord + 1 = s.section
       LEFT JOIN v_selection x ON f.audit_id = x.audit_id AND f.flag_id = x.flag_id""",
    ("v_audits", "v_flags"),
)
def _(v):
    return P.heatmap(v.audits(), v.flags(with_ord=True), selection=selection(v))


@query(
    "a62_heatmap_ten_sections",
    """SELECT a.audit_id, CAST(s.section AS INT) AS section, f.flag_id, f.flag_id IS NULL AS is_clean,
         coalesce(f.ord = 0, FALSE) AS has_selected
       FROM v_audits a CROSS JOIN range(1, 11) s(section)
       LEFT JOIN v_flags f ON a.audit_id = f.audit_id AND f.ord + 1 = s.section""",
    ("v_audits", "v_flags"),
)
def _(v):
    # ten sections, with the first flag of each audit selected
    flags = v.flags(with_ord=True)
    chosen = pick_flag(flags).select("audit_id", "flag_id")
    return P.heatmap(v.audits(), flags, 10, chosen).select(
        "audit_id", "section", "flag_id", "is_clean", "has_selected"
    )


#: A break stands for the end of a block; runs of white space with one become one.
_SPACED = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({text}, '[ \t\n\x0b\f\r]+', ' ', 'g'), ' ?\x{{2029}} ?', chr(8233), 'g'),
     '\x{{2029}}+', chr(8233), 'g'), '^\x{{2029}}|\x{{2029}}$', '', 'g'))"""
SENTENCES = r"""parts AS (SELECT {key}, string_split(replace(regexp_replace(t, '([.!?]+) ', '\1' || chr(1), 'g'), chr(8233), chr(1)), chr(1)) AS p
     FROM (SELECT {key}, """ + _SPACED + r""" AS t FROM {table}) a WHERE t <> ''),
   sent AS (SELECT {key}, CAST(i AS INT) AS sentence_no, p[i] AS sentence,
     CAST(coalesce(list_sum(list_transform(p[1:i - 1], lambda s: length(s) + 1)), 0) AS BIGINT) AS char_start FROM (
       SELECT {key}, p, unnest(range(1, len(p) + 1)) AS i FROM parts) b)"""
#: The comparison engine's patterns have no look-behind, and need none.
_SQL_PATTERNS = [(c, p.replace(K.EMAIL, r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")) for c, p in K.CLAIM_PATTERNS]


def _stripped_sql() -> str:
    """The markup patterns without possessive loops, of which the comparison engine needs none."""
    text = "html"
    for pattern, by in K.MARKUP:
        plain = pattern.replace("++", "+").replace("*+", "*").replace("?+", "?").replace("'", "''")
        text = f"regexp_replace({text}, '{plain}', '{by.replace('$1', chr(92) + '1')}', 'g')"
    return text


#: Named entities; the comparison engine looks them up in a map.
_QUOTED = [["'" + x.replace("'", "''") + "'" for x in pair] for pair in K.ENTITIES.items()]
_ENTITY_MAP = "MAP {" + ", ".join(f"{n}: {c}" for n, c in _QUOTED) + "}"
STRIPPED = f"""list_reduce(list_prepend(stripped, list_distinct(regexp_extract_all(stripped, '{K.ENTITY}'))),
     lambda t, e: replace(t, e, coalesce(named[e], e)))"""
for _entity in K.AMPERSANDS:
    STRIPPED = f"replace({STRIPPED}, '{_entity}', '&')"
PAGE_TEXTS = f"""(SELECT page_id, {STRIPPED} AS page_text FROM (
     SELECT page_id, replace({_stripped_sql()}, '&#39;', chr(39)) AS stripped FROM pages) p, (SELECT {_ENTITY_MAP} AS named) n)"""


@query(
    "b04_canonical_text",
    "WITH " + SENTENCES.format(key="page_id", text="page_text", table=PAGE_TEXTS)
    + " SELECT page_id, sentence_no, sentence, char_start, CAST(char_start + length(sentence) AS BIGINT) AS char_end FROM sent",
)
def _(v):
    return K.canonical_stream(v.table("pages"), "page_id", K.strip_markup(C("html")))


@query(
    "b04_document_sentences",
    "WITH " + SENTENCES.format(key="doc_id", text="text", table="documents")
    + " SELECT doc_id, sentence_no, char_start, CAST(char_start + length(sentence) AS BIGINT) AS char_end FROM sent",
)
def _(v):
    return K.canonical_stream(v.table("documents"), "doc_id", C("text")).drop("sentence")


@query(
    "b05_extract_claims",
    "WITH " + SENTENCES.format(key="doc_id", text="text", table="documents")
    + ", hits AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, sentence_no, {i} AS c, '{category}' AS category, v, unnest(range(1, len(v) + 1)) AS j FROM"
        f" (SELECT doc_id, sentence_no, regexp_extract_all(sentence, '{pattern}') AS v FROM sent) x"
        for i, (category, pattern) in enumerate(_SQL_PATTERNS)
    )
    + """) SELECT doc_id, sentence_no, CAST(row_number() OVER (PARTITION BY doc_id, sentence_no ORDER BY c, j) AS INT) AS value_no,
        category, v[j] AS value FROM hits""",
)
def _(v):
    sentences = K.canonical_stream(v.table("documents"), "doc_id", C("text"))
    return K.extract_claims(sentences, "doc_id").drop("sentence")
