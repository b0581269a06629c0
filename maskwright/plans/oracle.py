"""SQL building blocks for checking the registered queries in another database.

The checks work on rows (one per match, one per span) with window functions, unlike the
expressions they check, which work on arrays inside a row.
"""

from __future__ import annotations

from maskwright.functions import masking, registry
from maskwright.functions.policy import Policy
from maskwright.plans.corpus import CORPUS_SQL

CORPUS = CORPUS_SQL.format(customer="customer")
CORPUS_SRC = f"select doc_id as id, text from ({CORPUS})"
DOCUMENTS_SRC = "select doc_id as id, text from documents"
PAGES_SRC = "select page_id as id, html as text from pages"
URLS_SRC = "select page_id as id, url as text from pages"
MARK = "chr(57344)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


HIGH = strings(registry.HIGH_RISK_TYPES)
MEDIUM = strings(registry.MEDIUM_RISK_TYPES)
WEIGHT = (
    f"case when typ in {HIGH} then 3.0::double when typ in {MEDIUM} then 2.0::double "
    "when typ like 'BUSINESS\\_%' escape '\\' then 2.5::double else 1.0::double end"
)


def keyword_test(text: str, keywords) -> str:
    return "(" + " or ".join(f"contains(lower({text}), {quoted(k)})" for k in keywords) + ")" if keywords else "false"


def raw_ctes(src: str, types=None, external: str | None = None) -> str:
    """CTEs src(id, text) and raw(id, s, e, seq, typ, conf, source, txt)."""
    parts = []
    for seq, r in enumerate(registry.RECOGNIZERS):
        if types is not None and r.entity_type not in types:
            continue
        regex = quoted(("(?i)" if r.ignore_case else "") + f"({r.pattern})")
        conf = (
            "0.8::double"
            if r.source == registry.BUSINESS
            else f"case when {keyword_test('text', r.keywords)} then 0.9::double else 0.7::double end"
        )
        parts.append(
            f"select id, {seq} as seq, '{r.entity_type}' as typ, '{r.source}' as source, {conf} as conf, "
            f"string_split(regexp_replace(text, {regex}, {MARK} || '\\1' || {MARK}, 'g'), {MARK}) as segs "
            f"from src where regexp_matches(text, {regex})"
        )
    extra = f" union all {external}" if external else ""
    return (
        f"src as ({src}), marked as ({' union all '.join(parts)}), "
        "pieces as (select id, seq, typ, source, conf, unnest(segs) as txt, "
        "generate_subscripts(segs, 1) as ord from marked), "
        "placed as (select *, sum(length(txt)) over (partition by id, seq order by ord) as stop from pieces), "
        "raw as (select id, (stop - length(txt))::int as s, stop::int as e, seq, typ, conf, source, txt "
        f"from placed where ord % 2 = 0{extra})"
    )


def detection_ctes(src: str, external: str | None = None, custom: bool = True) -> str:
    """raw_ctes plus ent(id, ord, typ, s, e, c, txt, context) and doc(id, text, n, risk, high)."""
    types = None if custom else list(registry.BUSINESS_PATTERNS)
    return (
        raw_ctes(src, types, external)
        + """,
grouped as (select id, list({'s': s, 'e': e, 'c': conf, 'typ': typ, 'txt': txt} order by s, e, seq) as l from raw group by id),
resolved as (select id, list_reduce(list_transform(l, lambda x: [x]), lambda a, b:
  case when b[1].s > a[len(a)].e then list_concat(a, b)
       when b[1].c > a[len(a)].c then list_concat(a[1:len(a)-1], b) else a end) as l from grouped),
ent0 as (select id, unnest(l) as x, generate_subscripts(l, 1) as ord from resolved),
ent as (select ent0.id, ord, x.typ as typ, x.s as s, x.e as e, x.c as c, x.txt as txt,
  substring(text, greatest(x.s - 50, 0) + 1, x.e + 50 - greatest(x.s - 50, 0)) as context
  from ent0 join src on src.id = ent0.id),
scored as (select id, count(*) as n, list("""
        + f"c * ({WEIGHT}) order by ord) as parts, bool_or(typ in {HIGH}) as high"
        + """ from ent group by id),
doc as (select src.id, src.text, coalesce(n, 0)::int as n, coalesce(high, false) as high,
  case when n is null then 0.0::double else least(1.0::double, list_reduce(parts, lambda a, b: a + b) / (n * 3.0::double)) end as risk
  from src left join scored on scored.id = src.id)"""
    )


def two_decimals(value: str) -> str:
    return f"printf('%.2f', {value})"


def stars(count: str, char: str = "'*'") -> str:
    return f"repeat({char}, greatest({count}, 0)::int)"


def mask_sql(kind: str, txt: str = "txt", typ: str = "typ", char: str = "'*'", salt: str = masking.DEFAULT_SALT) -> str:
    size = f"length({txt})"
    default = (
        f"case when {size} > 2 then left({txt}, 1) || {stars(size + ' - 2', char)} || right({txt}, 1) "
        f"else {stars(size, char)} end"
    )
    if kind == "full":
        return stars(size, char)
    if kind == "partial":
        return (
            f"case when {typ} = 'EMAIL' and contains({txt}, '@') then left({txt}, 1) || "
            f"{stars(f'instr({txt}, chr(64)) - 2', char)} || substring({txt}, instr({txt}, '@')) "
            f"when {typ} = 'PHONE_NUMBER' and {size} >= 7 then left({txt}, 3) || {stars(size + ' - 6', char)} || right({txt}, 3) "
            f"when {typ} in ('CREDIT_CARD', 'US_SSN') and {size} >= 4 then {stars(size + ' - 4', char)} || right({txt}, 4) "
            f"else {default} end"
        )
    if kind == "hash":
        return f"'[HASH_' || upper(left(sha256({txt} || '{salt}'), 8)) || ']'"
    if kind == "redact":
        return f"'[REDACTED_' || {typ} || ']'"
    if kind == "synthetic":
        draw = lambda n: f"('0x' || left(md5({txt} || ':0:{n}'), 15))::bigint"
        pick = lambda choices, n: f"list_extract({choices}, 1 + ({draw(n)} % {len(choices)})::int)"
        between = lambda n, low, high: f"({draw(n)} % {high - low + 1} + {low})::varchar"
        letters = " || ".join(pick(list(masking.LETTERS), n) for n in range(11, 19))
        return (
            f"case {typ} when 'EMAIL' then {letters} || '@' || {pick(masking.SYNTHETIC_EMAIL_DOMAINS, 0)} "
            f"when 'PHONE_NUMBER' then '555-' || {between(1, 100, 999)} || '-' || {between(2, 1000, 9999)} "
            f"when 'PERSON' then {pick(masking.SYNTHETIC_FIRST_NAMES, 1)} || ' ' || {pick(masking.SYNTHETIC_LAST_NAMES, 2)} "
            f"when 'IP_ADDRESS' then '192.168.' || {between(1, 1, 255)} || '.' || {between(2, 1, 255)} "
            f"when 'CREDIT_CARD' then '{masking.SYNTHETIC_CREDIT_CARD}' when 'US_SSN' then '{masking.SYNTHETIC_SSN}' "
            f"else '[SYNTHETIC_' || {typ} || ']' end"
        )
    raise ValueError(kind)


def spliced_cte(name: str, replacement: str, ents: str = "ent") -> str:
    """CTE (id, masked): text of src with every span of ``ents`` replaced."""
    return f"""{name}_parts as (select id, ord, e, replacement, coalesce(lag(e) over (partition by id order by ord), 0) as prev, s
  from (select {ents}.*, ({replacement}) as replacement from {ents})),
{name}_joined as (select p.id, string_agg(substring(text, prev + 1, s - prev) || replacement, '' order by ord) as head, max(e) as last_end
  from {name}_parts p join src on src.id = p.id group by p.id),
{name} as (select src.id, case when head is null then src.text else head || substring(src.text, last_end + 1) end as masked
  from src left join {name}_joined j on j.id = src.id)"""


def policy_values(policy: Policy | None = None) -> str:
    policy = policy or Policy()
    rows = ", ".join(
        f"('{name}', '{row['action']}', {float(row['confidence_threshold'])}::double, '{row.get('mask_type', 'full')}')"
        for name, row in policy.entities.items()
    )
    return f"pol(typ, action, thr, mtype) as (values {rows})"


PRIORITY = "case action when 'block' then 4 when 'mask' then 3 when 'warn' then 2 else 1 end"
JUDGED = (
    "judged as (select ent.*, coalesce(pol.action, 'mask') as action, coalesce(pol.thr, 0.8::double) as thr, "
    "coalesce(pol.mtype, 'full') as mtype from ent left join pol on pol.typ = ent.typ)"
)
CAN_BYPASS = "((role = 'admin' and typ in ('PERSON', 'LOCATION')) or (role = 'analyst' and typ = 'LOCATION'))"


def decision_ctes(
    src: str, roles: str = "select 'user' as role, false as bypass", external: str | None = None, policy: Policy | None = None
) -> str:
    """detection_ctes plus considered(...) and dec(id, role, bypass, action, thr, bypass_allowed, reasons)."""
    rest = (policy or Policy()).default
    judged = JUDGED.replace("'mask'", f"'{rest['action']}'").replace("0.8::double", f"{rest['confidence_threshold']}::double")
    return (
        detection_ctes(src, external)
        + f""", {policy_values(policy)}, {judged},
callers as ({roles}),
considered as (select judged.*, role, bypass, {PRIORITY} as pri from judged, callers
  where c >= thr and not (bypass and {CAN_BYPASS})),
best as (select id, role, bypass, arg_max(action, pri) as action, count(*) as taken,
  list(typ || ': ' || action || ' (confidence: ' || {two_decimals('c')} || ')' order by ord) as why from considered group by id, role, bypass),
peak as (select id, max(c) as top, list(distinct typ order by typ) filter (typ in {HIGH}) as risky from ent group by id),
dec as (select doc.id, callers.role, callers.bypass,
  case when n = 0 then 'allow' when n > 5 then 'block'
       when high and not callers.bypass and coalesce(best.action, 'allow') in ('allow', 'warn') then 'block'
       else coalesce(best.action, 'allow') end as action,
  case when n = 0 then 0.0::double when n > 5 then 1.0::double else top end as thr,
  case when n = 0 then true when n > 5 or taken > 0 or (high and not callers.bypass) then callers.role in ('admin', 'analyst') else true end as bypass_allowed,
  case when n = 0 then 'No PII detected' when n > 5 then 'Too many PII entities detected: ' || n || ' > 5'
       else array_to_string(list_concat(list_concat(
         case when top >= 0.95 then ['High confidence PII detected: ' || {two_decimals('top')} || ' >= 0.95'] else []::varchar[] end,
         coalesce(why, []::varchar[])),
         case when high and not callers.bypass then ['High-risk PII detected: ' || array_to_string(risky, ', ')] else []::varchar[] end), ' | ') end as reasons
  from doc cross join callers left join best on best.id = doc.id and best.role = callers.role and best.bypass = callers.bypass
  left join peak on peak.id = doc.id)"""
    )


BLOCK_MESSAGE = (
    "'Content blocked due to sensitive information detection. Detected PII types: ' || "
    "coalesce(types, '') || '. Risk Score: ' || " + two_decimals("risk")
)
TYPES_CTE = "types as (select id, string_agg(distinct typ, ', ' order by typ) as types from ent group by id)"


def sanitize_ctes(src: str, external: str | None = None) -> str:
    """decision_ctes plus out(id, action, sanitized, blocked_reason, n, risk, high)."""
    choice = (
        "case when mtype_used = 'partial' then " + mask_sql("partial") + " else " + mask_sql("full") + " end"
    )
    return (
        decision_ctes(src, external=external)
        + f""",
ent_cfg as (select ent.*, case when considered.action = 'mask' then considered.mtype else 'full' end as mtype_used
  from ent left join (select distinct id, typ, action, mtype from considered) considered on considered.id = ent.id and considered.typ = ent.typ),
{spliced_cte('spl', choice, 'ent_cfg')}, {TYPES_CTE},
out as (select doc.id, doc.text, n, risk, high, dec.action,
  case dec.action when 'block' then '[CONTENT BLOCKED DUE TO PII DETECTION]' when 'mask' then masked else doc.text end as sanitized,
  case when dec.action = 'block' then {BLOCK_MESSAGE} end as blocked_reason, masked
  from doc join dec on dec.id = doc.id join spl on spl.id = doc.id left join types on types.id = doc.id)"""
    )
