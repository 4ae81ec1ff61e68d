"""DuckDB twins of the training-data queries that SQL can express."""

from __future__ import annotations

from spanwright.llm.pii import KINDS
from spanwright.llm.urls import RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of op 2 and op 9: runs of digits, letters and characters beyond ASCII, A to Z lower-cased.
WORDS = rf"regexp_extract_all(translate(coalesce(text,''),'{UPPER}','{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: All windows of all documents beside all windows of all items.
DECONTAMINATION = f"""
with d as materialized (select row_number() over () as rid, doc_id, {WORDS} as w from documents), b as (select item_id, {WORDS} as w from benchmark),
iw as materialized (select distinct item_id, n, array_to_string(w[p:p+n-1],' ') as g from (select item_id, w, least(10,len(w)) as n from b where len(w)>0) x, unnest(range(1,len(w)-n+2)) as t(p)),
dw as (select rid, p, n, array_to_string(w[p:p+n-1],' ') as g from (select rid, w, n from d, (select distinct n from iw) l where len(w)>=n) x, unnest(range(1,len(w)-n+2)) as t(p)),
hit as materialized (select rid, p, dw.n, item_id from dw join iw on iw.n=dw.n and iw.g=dw.g),
words as (select rid, count(distinct p+k) as n_hit from hit, unnest(range(0,n)) as t(k) group by rid),
items as (select rid, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct cast(item_id as varchar))),',') as items from hit group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit,0) as n_hit, coalesce(n_items,0) as n_items, sha256(coalesce(items,'')) as items_sha256, coalesce(n_hit,0)>0 as contaminated
from d left join words using(rid) left join items using(rid)"""

#: All pairs of texts that share a run of five words, by the overlap of their multisets of runs.
NEAR_DUPLICATES = f"""
with recursive d as materialized (select row_number() over () as rid, doc_id, {WORDS} as w from documents),
runs as (select rid, unnest(case when len(w)>=5 then list_transform(range(1,len(w)-3), lambda p: array_to_string(w[p:p+4],' ')) else [array_to_string(w,' ')] end) as run from d where len(w)>0),
counted as materialized (select rid, run, count(*) as n from runs group by all),
bag_of as materialized (select rid, md5(string_agg(run||'#'||n,'|' order by run)) as bag, sum(n) as size from counted group by rid),
reps as (select bag, min(rid) as rid, any_value(size) as size from bag_of group by bag),
held as materialized (select r.bag, run, n from reps r join counted c using(rid)),
met as (select x.bag as a, y.bag as b, sum(least(x.n,y.n)) as o from held x join held y on x.run=y.run and x.bag<y.bag group by 1,2),
link as materialized (select a, b from met join reps p on p.bag=a join reps q on q.bag=b where 9*o>=4*(p.size+q.size)),
near as (select a, b from link union select b, a from link),
reach(bag, top) as (select bag, bag from reps union select n.b, r.top from reach r join near n on n.a=r.bag),
class as (select bag, min(top) as class from reach group by bag),
of_doc as (select d.doc_id, coalesce(class, 'row '||d.rid) as class from d left join bag_of using(rid) left join class using(bag)),
least_of as (select class, min(doc_id) as group_id from of_doc group by class)
select doc_id, group_id, doc_id=group_id as keep from of_doc join least_of using(class)"""


#: The unsigned crc32 of a short text ``s``, bit by bit.
CRC32 = """xor(list_reduce(list_transform(range(1,length(s)+1), lambda i: cast(ascii(s[i]) as bigint)), lambda c, b: list_reduce(list_concat([xor(c,b)],range(0,8)),
    lambda x, i: xor(x>>1, case when x%2=1 then 3988292384 else 0 end)), 4294967295::bigint), 4294967295)"""


def _manifest() -> str:
    def leaf(text: str) -> str:
        parts = ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)", text)
        return "sha256(" + "||".join(f"coalesce(strlen({v})||':'||{v},'-')" for v in parts) + ")"

    def levels(name: str, base: str) -> str:
        return f"""{name}(tree, k, pos, h, n) as (select tree, 0::bigint, pos, h, n from {base} union all
            select tree, k+1, pos//8, sha256(string_agg(h,'' order by pos)), any_value((n+7)//8) from {name} where n>1 group by tree, k, pos//8)"""

    return f"""with recursive d as materialized (select row_number() over () as rid, doc_id, lang, coalesce('='||lang,'-') as tree, {leaf("text")} as h,
        {leaf(f"(case when {CRC32}%3=0 then translate(text,'{UPPER}','{LOWER}') else text end)")} as changed from (select *, coalesce(cast(doc_id as varchar),'') as s from documents) q),
    leaves as materialized (select *, row_number() over (partition by tree order by doc_id nulls first, h, changed)-1 as pos, count(*) over (partition by tree) as n from d),
    {levels("low", "leaves")}, subroots as materialized (select tree, h, row_number() over (order by tree)-1 as pos, count(*) over () as n from low where n=1),
    {levels("high", "(select '' as tree, pos, h, n from subroots)")},
    runs as materialized (select tree, k, pos//8 as run, list(h order by pos) as members, any_value(n) as n from (select * from low union all select * from high) q where n>1 group by tree, k, pos//8),
    climb(rid, home, tree, k, pos, h, proof) as (select rid, tree, tree, 0::bigint, pos, changed, '' from leaves union all
        select c.rid, c.home, case when r.run is null then '' else c.tree end, case when r.run is null then 0 else c.k+1 end, case when r.run is null then s.pos else c.pos//8 end,
            case when r.run is null then c.h else sha256(array_to_string(members[1:c.pos%8],'')||c.h||array_to_string(members[c.pos%8+2:],'')) end,
            case when r.run is null then proof else proof||array_to_string(members[1:c.pos%8],'')||array_to_string(members[c.pos%8+2:],'') end
        from climb c left join runs r on r.tree=c.tree and r.k=c.k and r.run=c.pos//8 join subroots s on s.tree=c.home where r.run is not null or c.tree<>''),
    ended as (select rid, arg_max(h,k) as h, arg_max(proof,k) as proof from climb where tree='' group by rid), top as (select h as root from high where n=1)
    select doc_id, l.h as leaf, s.h as subroot, root, sha256(proof) as proof_sha256, e.h as folded_root, e.h=root as verified from leaves l join ended e using(rid) join subroots s using(tree) cross join top"""


#: Every source with every kept term of its language.
DIVERGENCE = f"""
with d as materialized (select row_number() over () as rid, coalesce(lang,'') as lang, coalesce(source,'') as source, regexp_extract_all(translate(coalesce(text,''),'{UPPER}','{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
tok as (select rid, lang, source, unnest(w) as term from d), cnt as materialized (select lang, source, term, count(*) as n, count(distinct rid) as docs from tok group by all),
kept as materialized (select lang, term, sum(n) as n from cnt group by all having sum(docs)>=3), langs as materialized (select lang, count(*) as v, sum(n) as total from kept group by all),
named as materialized (select distinct lang, source from d), total as (select lang, source, sum(c.n) as total from cnt c join kept k using(lang,term) group by all),
p as materialized (select g.lang, g.source, k.term, coalesce(c.n,0) as n, 1+(1000000000::hugeint*(coalesce(c.n,0)+1))//(coalesce(t.total,0)+l.v)::hugeint as p, 1+(1000000000::hugeint*(k.n+1))//(l.total+l.v)::hugeint as q
    from named g join kept k using(lang) join langs l using(lang) left join total t using(lang,source) left join cnt c on c.lang=g.lang and c.source=g.source and c.term=k.term),
pair as (select a.lang, a.source, b.source as item, sum((a.p-b.p)*(a.p-b.p)//b.p) as value from p a join p b on a.lang=b.lang and a.term=b.term and a.source<>b.source group by all),
rows as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value,0)::bigint as value from named a join named b on a.lang=b.lang and a.source<>b.source left join pair r on r.lang=a.lang and r.source=a.source and r.item=b.source
    union all select lang, source, 'term', term, ((p-q)*(p-q)//q)::bigint from p where n>0 and p>q)
select * from (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from rows) r where part='pair' or rank<=200"""


def _url_rules() -> str:
    rule = "null"
    for r in sorted(RULES, key=lambda r: (len(r), r)):
        name, _, path = r.partition("/")
        rule = f"case when (host='{name}' or ends_with(host,'.{name}')) and starts_with(path,'/{path}') then '{r}' else {rule} end"
    parts = f"translate(coalesce(regexp_extract(url,'://([^/?#]*)',1),''),'{UPPER}','{LOWER}') as host, coalesce(regexp_extract(url,'://[^/?#]*([^?#]*)',1),'') as path"
    return f"select page_id, host, path, cast({rule} as varchar) as rule from (select page_id, {parts} from pages) q"


def _pii_base() -> str:
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    digits = "regexp_replace(m,'[^0-9]','','g')"
    luhn = f"list_sum(list_transform(range(1,length({digits})+1), lambda i: case when i%2=1 then cast(reverse({digits})[i] as int) else (case when cast(reverse({digits})[i] as int)>4 then cast(reverse({digits})[i] as int)*2-9 else cast(reverse({digits})[i] as int)*2 end) end))%10=0"
    good = {
        "email": "true",
        "ip": "list_max(list_transform(string_split(m,'.'), lambda p: try_cast(p as hugeint)))<=255 and len(list_filter(string_split(m,'.'), lambda p: try_cast(p as hugeint) is null))=0",
        "card": f"length({digits}) between 12 and 19 and {luhn}",
        "phone": f"length({digits}) between 9 and 15",
    }
    parts = []
    for rank, (kind, p) in enumerate(patterns.items()):
        # What stands between the matches tells their places
        cut = f"select rid, regexp_extract_all(t,'{p}') as ms, regexp_split_to_array(t,'{p}') as gaps from d"
        each = f"select rid, unnest(list_transform(range(1,len(ms)+1), lambda i: {{'m': ms[i], 's': list_sum(list_transform(gaps[1:i], lambda g: length(g)))+coalesce(list_sum(list_transform(ms[1:i-1], lambda g: length(g))),0)}})) as x from ({cut}) c"
        parts.append(f"select rid, '{kind}' as kind, {rank} as rank, m, s from (select rid, x.m as m, cast(x.s as bigint) as s from ({each}) e) q where {good[kind]}")
    counts = ", ".join(f"count(*) filter (where kind='{k}') as n_{k}" for k in KINDS[:4])
    return f"""with d as materialized (select row_number() over () as rid, doc_id, coalesce(text,'') as t from documents), spans as ({" union all ".join(parts)})
        select doc_id, {counts}, sha256(coalesce(string_agg(kind||':'||s||':'||(s+length(m)),',' order by s, rank),'')) as base_sha256 from d left join spans using(rid) group by rid, doc_id"""


URL_RULES, PII_BASE, MANIFEST = _url_rules(), _pii_base(), _manifest()
