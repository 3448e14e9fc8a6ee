"""DuckDB SQL of the queries that SQL can express: exact duplicates by the
normalised text itself, and the Merkle manifest by recursive queries (its CRC-32
from a table made by rule)."""

EXACT_DEDUP = r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, sha256(t) as text_sha256
from d window w as (partition by t)"""


def _encoded(c: str) -> str:
    return f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"


def _record(n_chars: str) -> str:
    return "sha256(" + " || ".join(_encoded(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: All levels of the trees over the rows of each run.
_TREE = """
{t}(lvl, run, pos, cnt, h) as (
  select 0, {run}, row_number() over (partition by {run} order by {order}) - 1, count(*) over (partition by {run}), {leaf} from {source}
  union all
  select any_value(lvl) + 1, any_value(run), pos // 2, (any_value(cnt) + 1) // 2, sha256(string_agg(h, '' order by pos))
  from {t} where cnt > 1 group by coalesce('=' || run, ''), pos // 2),
"""
MERKLE = f"""
with recursive
crc(i, k, c) as (
  select i, 0, i from range(256) r(i) union all
  select i, k + 1, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc where k < 8),
tab as (select list(c order by i) as t from crc where k = 8),
docs as (
  select doc_id, lang, row_number() over (partition by lang order by doc_id) - 1 as pos,
         {_record('n_chars')} as leaf, {_record('n_chars + 1')} as other,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
             lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]))) % 7 = 0 as hit
  from documents, tab),
{_TREE.format(t='tree', run='lang', order='doc_id', leaf='leaf', source='docs')}
subs as (select run, h as subroot from tree where cnt = 1),
runs as (select run, subroot, row_number() over (order by run nulls first) - 1 as place from subs),
{_TREE.format(t='top', run="''", order='place', leaf='subroot', source='runs')}
steps as (
  select doc_id, 0 as part, n.lvl, d.pos >> n.lvl as turn, s.h as sibling
  from docs d join tree n on n.run is not distinct from d.lang and n.pos = d.pos >> n.lvl and n.cnt > 1
  left join tree s on s.run is not distinct from d.lang and s.lvl = n.lvl and s.pos = xor(d.pos >> n.lvl, 1)
  union all
  select doc_id, 1, n.lvl, r.place >> n.lvl, s.h
  from docs d join runs r on r.run is not distinct from d.lang join top n on n.pos = r.place >> n.lvl and n.cnt > 1
  left join top s on s.lvl = n.lvl and s.pos = xor(r.place >> n.lvl, 1)),
proof as (
  select doc_id, sha256(string_agg(coalesce(sibling, ''), '' order by part, lvl)) as proof_sha256,
         list({{'odd': turn, 's': coalesce(sibling, '')}} order by part, lvl) as path
  from steps group by doc_id),
fold(doc_id, i, node, path) as (
  select d.doc_id, 0, case when hit then other else leaf end, coalesce(path, []) from docs d left join proof p on p.doc_id = d.doc_id
  union all
  select doc_id, i + 1, sha256(case when path[i + 1].odd % 2 = 1 then path[i + 1].s || node else node || path[i + 1].s end), path
  from fold where i < len(path))
select d.doc_id, d.leaf, r.subroot, t.h as root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, f.node as folded_root, f.node = t.h as verified
from docs d join runs r on r.run is not distinct from d.lang join top t on t.cnt = 1
left join proof p on p.doc_id = d.doc_id join fold f on f.doc_id = d.doc_id and f.i = len(f.path)"""
