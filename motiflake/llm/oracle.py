"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

from .chat import ESCAPES, TEMPLATE
from .rules import RULES, STOP_WORDS

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SOLID = r"[^\x20\x09-\x0D]+"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UP}', '{_LOW}'), '{pattern}')"


OP3 = f"""
with dw as (select doc_id, {_words('text', _ALNUM)} ws from documents), iw as (select item_id, {_words('text', _ALNUM)} ws from benchmark),
items as (select item_id, ws, least(10, len(ws)) l, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) i from iw where len(ws) > 0),
win as (select distinct item_id, l, array_to_string(ws[i:i+l-1], ' ') g from items), ls as (select distinct l from win),
dwin as (select doc_id, l, p, array_to_string(ws[p:p+l-1], ' ') g from (select doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) p from dw, ls where len(ws) >= l)),
hits as (select doc_id, p, l, item_id from dwin join win using (l, g)),
cov as (select doc_id, count(distinct w) n_hit from (select doc_id, unnest(range(p, p + l)) w from hits) group by 1),
its as (select doc_id, count(*) n_items, sha256(string_agg(i, ',' order by i)) s from (select distinct doc_id, cast(item_id as varchar) i from hits) group by 1)
select doc_id, cast(len(ws) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, coalesce(s, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join cov using (doc_id) left join its using (doc_id)
"""


def _keep(chars: str) -> str:
    """How many of a text's characters are among chars."""
    return f"(length(t) - length(translate(t, '{chars}', '')))"


_BLANK = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_RATIO = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "word_chars"),
    "upper_ratio": (_keep("ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÉÈÊËÎÏÔÙÛÑÓÍÚÁ"), "word_chars"),
    "bang_ratio": ("(length(t) - length(replace(t, '!!', ''))) // 2", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "len(ls)"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "digit_ratio": (_keep("0123456789"), "word_chars"),
    "separator_ratio": (_keep("|=_~^"), "word_chars"),
    "ellipsis_line_ratio": ("len(list_filter(ls, lambda x: suffix(x, '...') or suffix(x, '…')))", "len(ls)"),
    "bullet_line_ratio": ("len(list_filter(ls, lambda x: substr(ltrim(x, ' '), 1, 1) in ('-', '*', '•')))", "len(ls)"),
    "stop_ratio": ("n_stop", "n_words"),
}
_FAILS = " or ".join(
    f"coalesce({a} * 1.0e0 / nullif({b}, 0), 0) {sign} {bound}e0"
    for r in RULES
    for a, b in [_RATIO[r.metric]]
    for sign, bound in (("<", r.least), (">", r.most))
    if bound is not None
)
OP4 = rf"""
with w as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{_SOLID}') ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(translate(x, {_BLANK}, '')) > 0) ls from documents),
e as (select doc_id, unnest(ws) x, generate_subscripts(ws, 1) i from w),
g as (select doc_id, i, x||' '||lead(x) over o||' '||lead(x, 2) over o gram from e window o as (partition by doc_id order by i)),
r as (select doc_id, count(distinct p) n_repeat_words from (select doc_id, unnest([i, i+1, i+2]) p from (select *, count(*) over (partition by doc_id, gram) c from g where gram is not null) where c > 1) group by 1),
s as (select doc_id, count(*) filter (where lower(x) in ({', '.join(f"'{x}'" for x in sorted(set(STOP_WORDS)))})) n_stop from e group by 1),
m as (select doc_id, t, ls, cast(len(ws) as bigint) n_words, cast(length(translate(t, {_BLANK}, '')) as bigint) word_chars, cast({_keep('#*$%&|<>')} as bigint) n_symbols,
    cast(len(ls) - len(list_distinct(ls)) as bigint) n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words, coalesce(n_stop, 0) n_stop from w left join r using (doc_id) left join s using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({_FAILS}) kept from b
"""
OP5 = """
with p as (select page_id, coalesce(html, '') h from pages), d as (select page_id, cast(octet_length(encode(h)) as bigint) n, sha1(h) s from p),
m as (select s, max(page_id) rep from d where n >= 1000 group by s)
select page_id, n payload_bytes, d.s payload_digest, case when n >= 1000 and rep <> page_id then 'revisit' else 'response' end record_type,
    case when n >= 1000 and rep <> page_id then rep end refers_to
from d left join m on d.s = m.s
"""
OP7 = f"""
with recursive w as (select doc_id, {_words('text', _SOLID)} ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i+2], ' ') g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) i from w where len(ws) > 0)),
n as (select doc_id, count(*) n from s group by 1),
c as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)),
r(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from r join l on r.b = l.a)
select r.a doc_id, coalesce(n.n, 0) n_shingles, min(r.b) component_id from r left join n on n.doc_id = r.a group by 1, 2
"""


def _escaped(text: str) -> str:
    for a, b in ESCAPES:
        text = f"replace({text}, '{a}', '{b}')"
    return text


_SHELL = len(TEMPLATE["begin"]) + len(TEMPLATE["end"])
_TURN = sum(map(len, TEMPLATE["open"])) + len(TEMPLATE["close"])
OP10 = f"""
with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
    union all select * from (values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, r, t))
select conv_id, count(*) n_turns, sha256(string_agg(r||chr(10)||t||chr(10), '' order by turn, r, t)) turns_sha256,
    cast(coalesce(sum(length(t)) filter (where r = 'assistant'), 0) as bigint) loss_chars, sha256(coalesce(string_agg(t, '' order by turn, r, t) filter (where r = 'assistant'), '')) loss_sha256,
    cast({_SHELL} + sum({_TURN} + length({_escaped('r')}) + length({_escaped('t')})) as bigint) formatted_chars,
    regexp_full_match(string_agg(r||'>', '' order by turn, r, t), '(system>)?user>assistant>((user|tool)>assistant>)*') valid
from c group by conv_id
"""
SQL = {"op3_decontaminate": OP3, "op4_quality_rules": OP4, "op5_warc": OP5, "op7_jaccard_join": OP7, "op10_chat_format": OP10}
