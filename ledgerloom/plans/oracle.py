"""The same rows in DuckDB SQL, written from the rules rather than from the Spark code."""

from __future__ import annotations


def key(x: str) -> str:
    s = f"regexp_replace(regexp_replace(trim(cast({x} as varchar)), '^''', ''), '\\.0$', '')"
    return f"coalesce(upper(case when regexp_full_match({s}, '[0-9]+') then coalesce(nullif(ltrim({s}, '0'), ''), '0') else {s} end), 'NAN')"


def money_of(x: str) -> str:
    s = f"replace(replace(replace({x}, ',', ''), '$', ''), ' ', '')"
    return f"try_cast(case when {s} like '(%)' then '-' || substr({s}, 2, length({s}) - 2) else {s} end as double)"


def day_of(x: str) -> str:
    return f"coalesce(try_strptime({x}, '%Y-%m-%d'), try_strptime({x}, '%d/%m/%Y'), try_strptime({x}, '%Y/%m/%d'))"


DAYS = f"cast(floor((epoch_us(timestamp '2001-08-02 00:00:00') - epoch_us({day_of('\"Date\"')})) / 86400000000) as integer)"
BUCKET = f"case when {DAYS} is null then 'Unknown' when {DAYS} <= 30 then '0-30' when {DAYS} <= 60 then '31-60' when {DAYS} <= 90 then '61-90' when {DAYS} <= 120 then '91-120' else '121+' end"

TABLES = """
o as (select o_orderkey as k, o_totalprice as p, o_orderdate as d, o_orderpriority as pr, cast(o_custkey as varchar) as cu from orders),
base as (
  select case k % 4 when 0 then lpad(cast(k as varchar), 10, '0') when 1 then '''' || k when 2 then k || '.0' else '  ' || k || ' ' end as "Invoice",
    case k % 3 when 0 then strftime(d, '%Y-%m-%d') when 1 then strftime(d, '%d/%m/%Y') else strftime(d, '%Y/%m/%d') end as "Date",
    case k % 11 when 0 then '' when 1 then 'n/a' when 2 then '(' || printf('%.2f', p) || ')' when 3 then '$' || format('{:,.2f}', p) when 4 then printf('%.2f', p) || ' ' else printf('%.2f', p) end as "Amount",
    pr as "Priority", cu as "Customer" from o),
bank as (
  select cast(k as varchar) as "Invoice No",
    case when k % 5 = 1 then cast(round(cast(p as decimal(18,2)) * cast(0.95 as decimal(3,2)), 2) as double) when k % 7 = 0 then cast(cast(p as decimal(18,2)) + cast(12.34 as decimal(4,2)) as double) else p end as "Total",
    case when k % 13 = 0 then null when k % 9 = 0 then strftime(d + interval 1 day, '%d/%m/%Y') else strftime(d, '%d/%m/%Y') end as "Date",
    case k % 6 when 0 then substr(pr, 3) when 1 then 'OTHER' else pr end as "Priority" from o where k % 10 <> 0
  union all select cast(k + 10000000 as varchar), p, strftime(d, '%d/%m/%Y'), pr from o where k % 50 = 0),
ledger as (
  select k as "Ref", p as "Open Amount", cu as "Customer" from o where k % 3 <> 0
  union all select k, 0.0, cu from o where k % 3 <> 0 and k % 20 = 1)"""

KEYED = f"""{TABLES},
b as (select {key('"Invoice"')} as key, * from base),
r1 as (select {key('"Invoice No"')} as key, * from bank),
r2 as (select {key('"Ref"')} as key, * from ledger),
c1 as (select key, count(*) as n, max("Priority" is not null) as hit from r1 group by key),
c2 as (select key, count(*) as n, max("Customer" is not null) as hit from r2 group by key)"""

_NAMES = """concat_ws(', ', case when n1 > 0 then 'Bank' end, case when n2 > 0 then 'Ledger' end)"""
_DUPS = """concat_ws(', ', case when n1 = 0 then 'Bank: no entry' else 'Bank: ' || n1 || 'x' end, case when n2 = 0 then 'Ledger: no entry' else 'Ledger: ' || n2 || 'x' end)"""

DETAIL = f"""{KEYED},
detail as (
  select {BUCKET} as "Age Bucket", {DAYS} as "Age (Days)", b."Invoice", b."Date", b."Amount", b."Priority", b."Customer",
    r1."Invoice No" as "Bank_Invoice No", r1."Priority" as "Bank_Priority", coalesce(r1."Date", '') as "Bank_Date", r1."Total" as "Bank_Total",
    cast(n1 as bigint) as "Bank_Match_Count", r2."Ref" as "Ledger_Ref", r2."Customer" as "Ledger_Customer", r2."Open Amount" as "Ledger_Open Amount",
    cast(n2 as bigint) as "Ledger_Match_Count", {_NAMES} as "Match Source", {_DUPS} as "Duplicate Summary", r1."Date" as bank_day
  from (select b.*, coalesce(c1.n, 0) as n1, coalesce(c2.n, 0) as n2 from b left join c1 using (key) left join c2 using (key)) b
  left join r1 on b.key = r1.key left join r2 on b.key = r2.key)""".replace('("Date"', '(b."Date"').replace('"Date", \'%', 'b."Date", \'%').replace("b.b.", "b.")

_SHOWN = """ "Age Bucket", "Age (Days)", "Invoice", "Date", "Amount", "Priority", "Customer", "Bank_Invoice No", "Bank_Priority", "Bank_Date", "Bank_Total",
  "Bank_Match_Count", "Ledger_Ref", "Ledger_Customer", "Ledger_Open Amount", "Ledger_Match_Count", "Match Source", "Duplicate Summary" """

# a chain of full joins, each on the key so far
FULL_DETAIL = f"""{KEYED},
j1 as (
  select coalesce(b.key, r1.key) as key, b.key is not null as in_b, r1.key is not null as in_1, b."Invoice", b."Date", b."Amount", b."Priority", b."Customer",
    r1."Invoice No" as "Bank_Invoice No", r1."Priority" as "Bank_Priority", r1."Date" as "Bank_Date", r1."Total" as "Bank_Total"
  from b full join r1 on b.key = r1.key),
j2 as (
  select coalesce(j1.key, r2.key) as key, j1.key is not null as in_j1, j1.* exclude (key), r2."Ref" as "Ledger_Ref", r2."Customer" as "Ledger_Customer", r2."Open Amount" as "Ledger_Open Amount"
  from j1 full join r2 on j1.key = r2.key),
full_detail as (
  select case when in_b then {BUCKET} end as "Age Bucket", case when in_b then {DAYS} end as "Age (Days)", coalesce("Invoice", j2.key) as "Invoice", coalesce("Date", '') as "Date", "Amount", "Priority", "Customer",
    "Bank_Invoice No", "Bank_Priority", coalesce("Bank_Date", '') as "Bank_Date", "Bank_Total", case when in_j1 then n1 end as "Bank_Match_Count",
    "Ledger_Ref", "Ledger_Customer", "Ledger_Open Amount", n2 as "Ledger_Match_Count", {_NAMES} as "Match Source", {_DUPS} as "Duplicate Summary"
  from (select j2.*, coalesce(c1.n, 0) as n1, coalesce(c2.n, 0) as n2 from j2 left join c1 using (key) left join c2 using (key)) j2)"""


def _report(full: bool = False, n: int = 2) -> str:
    """CTEs ending in ``report``: all keys with amounts, Delta and Status."""
    sides = {"Bank": ("r1", '"Total"'), "Ledger": ("r2", '"Open Amount"')}
    used = list(sides)[:n]
    refs = ", ".join(f's_{s} as (select key, round_even(sum({c}), 2) as a, count(*) as n from {t} where {c} is not null group by key)' for s, (t, c) in list(sides.items())[:n])
    keys = " union ".join(["select key from s_base", *([f"select key from s_{s}" for s in used] if full else [])])
    amounts = ", ".join(f's_{s}.a as "{s} Amount"' for s in used)
    joins = " ".join(f"left join s_{s} on k.key = s_{s}.key" for s in used)
    present = " + ".join(f'cast("{s} Amount" is not null as integer)' for s in used)
    gaps = [f'(coalesce(base, 0) - "{s} Amount")' for s in used]
    top = "coalesce(greatest(" + ", ".join(f"abs({g})" for g in gaps) + "), 0)"
    worst = "round_even(coalesce(" + ", ".join(f"case when abs({g}) = top then {g} end" for g in gaps) + ", 0), 2)"
    ref_abs = "coalesce(greatest(" + ", ".join(f'abs("{s} Amount")' for s in used) + "), 0)"
    names = "concat_ws(', ', " + ", ".join(f"case when \"{s} Amount\" is not null then '{s}' end" for s in sorted(used)) + ")"
    label, who = ("ID / Key", "Master Amount") if full else ("Invoice #", "SOA Amount")
    fields = "" if full else """, case when abs("Delta") >= 0.01 then 'Mismatch: Amount' else '✓ All Match' end as "Mismatched Fields" """
    return f"""{KEYED},
s_base as (select key, round_even(sum(coalesce({money_of('"Amount"')}, 0)), 2) as a from b group by key), {refs},
m as (select k.key, s_base.a as base, {amounts}, {' + '.join(f'coalesce(s_{s}.n, 0)' for s in used)} as entries
  from ({keys}) k left join s_base on k.key = s_base.key {joins}),
m2 as (select *, {present} as present, {top} as top, {ref_abs} as ref_abs from m),
m3 as (select *, {worst} as worst, coalesce(base, 0) as amt from m2),
m4 as (select *,
  case when present = 0 and abs(amt) < 0.01 then 'NO DATA' when present = 0 then 'MISSING IN REF' when abs(amt) < 0.01 and ref_abs >= 0.01 then 'MISSING IN SOA'
    when top < 0.01 and present < {n} then 'PARTIAL (Some Refs Missing)' when top < 0.01 then 'MATCH' when present < {n} then 'MISMATCH (Partial)'
    when worst > 0 then 'Underpaid (Short)' else 'Overpaid (Excess)' end as "Status" from m3),
m5 as (select *, round_even(case "Status" when 'NO DATA' then 0 when 'MISSING IN REF' then amt when 'MISSING IN SOA' then -ref_abs
    when 'PARTIAL (Some Refs Missing)' then 0 when 'MATCH' then 0 else worst end, 2) as "Delta" from m4),
every as (select key as "{label}", base as "{who}", {', '.join(f'"{s} Amount"' for s in used)}, coalesce(nullif({names}, ''), '-') as "Ref_Sources", cast(entries as bigint) as "Ref_Count", "Delta", "Status"{fields} from m5),
report as (select * from every where "Status" <> 'MATCH')"""


_STATUS = """select "Status", count(*) as n_keys, round_even(sum("Delta"), 2) as delta from every group by "Status" """

BOTH = DETAIL + "," + _report().removeprefix(KEYED + ",")

SUMMARY = f"""
rows_ as (select count(*) as total_records, sum(coalesce({money_of('"Amount"')}, 0)) as base_total from detail),
gaps as (select count(*) as discrepancy_count, coalesce(round_even(sum(abs("Delta")), 2), 0) as total_discrepancy_value, coalesce(round_even(avg(abs("Delta")), 2), 0) as avg_discrepancy,
  coalesce(round_even(max(abs("Delta")), 2), 0) as max_discrepancy from report),
rate_ as (select *, total_records - discrepancy_count as match_count, round_even((total_records - discrepancy_count) / total_records * 100, 1) as match_rate from rows_, gaps),
summary as (select total_records, match_count, discrepancy_count, match_rate, total_discrepancy_value, avg_discrepancy, max_discrepancy,
  round_even(greatest(0, match_rate - least(20, total_discrepancy_value / abs(base_total) * 100)), 1) as health_score, cast(2 as bigint) as ref_count from rate_),
data_summary as (
  select 0 as ord, 'SOA (Master)' as "Source", count(*) as "Total Invoices", round_even(sum(coalesce({money_of('"Amount"')}, 0)), 2) as "Total Value", '100.0%' as "Match Rate vs SOA" from detail
  union all select 1, 'Bank', count("Bank_Total"), round_even(sum(coalesce("Bank_Total", 0)), 2), (select printf('%.1f', match_rate) || '%' from summary) from detail
  union all select 2, 'Ledger', count("Ledger_Open Amount"), round_even(sum(coalesce("Ledger_Open Amount", 0)), 2), (select printf('%.1f', match_rate) || '%' from summary) from detail),
status_breakdown as (
  select 'MATCH' as "Status", (select count(*) from detail) - (select count(*) from report) as "Count" union all select "Status", count(*) from report group by "Status"),
iqr as (select count("SOA Amount") as n, avg("SOA Amount") as mean, quantile_cont("SOA Amount", 0.5) as median, stddev_samp("SOA Amount") as std_dev,
  quantile_cont("SOA Amount", 0.25) as q1, quantile_cont("SOA Amount", 0.75) as q3 from report),
iqr_stats as (select round_even(mean, 2) as mean, round_even(median, 2) as median, round_even(std_dev, 2) as std_dev, round_even(q1, 2) as q1, round_even(q3, 2) as q3,
  round_even(q3 - q1, 2) as iqr, round_even(q1 - 1.5 * (q3 - q1), 2) as lower_bound, round_even(q3 + 1.5 * (q3 - q1), 2) as upper_bound, o.c as outlier_count, round_even(o.c / n * 100, 1) as outlier_pct
  from iqr, (select count(*) as c from report, iqr where "SOA Amount" < q1 - 1.5 * (q3 - q1) or "SOA Amount" > q3 + 1.5 * (q3 - q1)) o)"""

_POINTS = """case "Status" when 'PARTIAL (Some Refs Missing)' then 10 when 'MISSING IN REF' then 20 when 'MISSING IN SOA' then 25 when 'MISMATCH (Partial)' then 20 when 'NO DATA' then 25 else 15 end"""
RISK = f"""
scored as (select "Invoice #", cast(round_even(least(100, greatest(0, round_even(abs("Delta") / (select max(abs("Delta")) from report) * 40, 1) + {_POINTS}
  + round_even(least(1, greatest(0, 1 - "Ref_Count" / 2)) * 15, 1))), 0) as integer) as "Risk Score", "Status", "Delta" from report),
risk as (select "Invoice #", "Risk Score", case when "Risk Score" <= 25 then '🟢 Low' when "Risk Score" <= 50 then '🟡 Medium' when "Risk Score" <= 75 then '🟠 High' else '🔴 Critical' end as "Risk Level", "Status", "Delta" from scored)"""


def _pattern(source: str) -> str:
    ref = f'"{source} Amount"'
    return f"""
p_{source} as (select count(*) as n, count(d) as both_, count(*) filter (d > 0.01) as up, count(*) filter (d < -0.01) as down, avg(d) as gap,
  count(share) as shares, stddev_samp(share) as spread, avg(share) as share, count(*) filter (even) as even_
  from (select "SOA Amount" - {ref} as d, case when "SOA Amount" <> 0 then ("SOA Amount" - {ref}) / "SOA Amount" end as share, {ref} % 100 = 0 and "SOA Amount" is not null as even from report)),
f_{source} as (
  select 'Systematic Underpayment' as type, '{source}' as source, '{source} consistently reports LOWER amounts than SOA (avg gap: $' || printf('%.2f', round_even(abs(gap), 2)) || ')' as description,
    case when round_even(abs(gap), 2) > 100 then 'High' else 'Medium' end as severity, up as affected from p_{source} where both_ >= 3 and up > 0.8 * both_
  union all select 'Systematic Overpayment', '{source}', '{source} consistently reports HIGHER amounts than SOA (avg gap: $' || printf('%.2f', round_even(abs(gap), 2)) || ')',
    case when round_even(abs(gap), 2) > 100 then 'High' else 'Medium' end, down from p_{source} where both_ >= 3 and not up > 0.8 * both_ and down > 0.8 * both_
  union all select 'Fixed Percentage Offset', '{source}', '{source} deviates by a consistent ' || printf('%.1f', round_even(share * 100, 1)) || '% from SOA — possible fee/tax difference', 'Medium', shares
    from p_{source} where both_ >= 3 and shares > 3 and spread < 0.02 and abs(share) > 0.01
  union all select 'Data Gap', '{source}', '{source} is missing ' || (n - both_) || ' of ' || n || ' invoices (' || cast(round_even((n - both_) / n * 100, 0) as integer) || '%)',
    case when n - both_ > 0.5 * n then 'High' else 'Medium' end, n - both_ from p_{source} where both_ >= 3 and n - both_ > 0.3 * n and n > 5
  union all select 'Estimated Amounts', '{source}', '{source} has ' || even_ || ' amounts that are round numbers — may be estimates rather than actuals', 'Low', even_
    from p_{source} where both_ > 5 and even_ > 0.5 * both_)"""


PATTERNS = _pattern("Bank") + "," + _pattern("Ledger") + ", patterns as (select * from f_Bank union all select * from f_Ledger)"


def _money_text(x: str) -> str:
    return f"(case when {x} < 0 then '$-' else '$' end || format('{{:,.2f}}', abs({x})))"


def _number_text(x: str) -> str:
    return f"coalesce(case when {x} = floor({x}) then cast(cast({x} as bigint) as varchar) else regexp_replace(printf('%.2f', {x}), '\\.?0+$', '') end, '')"


def _plain(x: str) -> str:
    """Comparable text of a field for the row comparison."""
    s = f"replace(replace(replace(trim(coalesce({x}, '')), ' 00:00:00', ''), 'nan', ''), 'nat', '')"
    return _iso(s, f"lower({s})")


def _iso(s: str, other: str) -> str:
    ymd, dmy = r"([0-9]{4})[/-]([0-9]{1,2})[/-]([0-9]{1,2})", r"([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})"
    part = lambda p, i: f"lpad(regexp_extract({s}, '^{p}$', {i}), 2, '0')"
    return (
        f"case when regexp_full_match({s}, '{ymd}') then regexp_extract({s}, '^{ymd}$', 1) || '-' || {part(ymd, 2)} || '-' || {part(ymd, 3)} "
        f"when regexp_full_match({s}, '{dmy}') then regexp_extract({s}, '^{dmy}$', 3) || '-' || {part(dmy, 2)} || '-' || {part(dmy, 1)} else {other} end"
    )


def _compared(a: str, b: str, as_name: str) -> str:
    return f"{_plain(a)} as {as_name}_a, {_plain(b)} as {as_name}_b"


def _kind(n: str) -> str:
    return f"case when {n}_a = '' or {n}_b = '' or {n}_a = {n}_b then '' when contains({n}_a, {n}_b) or contains({n}_b, {n}_a) then 'p' else 'm' end as {n}"


_CANON = lambda x: _iso(f"replace(trim({x}), ' 00:00:00', '')", f"upper(replace(trim({x}), ' 00:00:00', ''))")

LINES = f"""{KEYED},
s_base as (select key, round_even(sum(coalesce({money_of('"Amount"')}, 0)), 2) as a from b group by key),
s_l as (select cast(l_orderkey as varchar) as key, round_even(sum(l_extendedprice), 2) as a, count(*) as n from lineitem group by 1),
s_g as (select key, round_even(sum("Open Amount"), 2) as a, count(*) as n from r2 group by key),
line_sums as (select k.key as "ID / Key", s_base.a as "Master Amount", s_l.a as "Lines Amount", s_g.a as "Ledger Amount",
  coalesce(nullif(concat_ws(', ', case when s_g.n > 0 then 'Ledger' end, case when s_l.n > 0 then 'Lines' end), ''), '-') as "Ref_Sources", coalesce(s_l.n, 0) + coalesce(s_g.n, 0) as "Ref_Count"
  from (select key from s_base union select key from s_l union select key from s_g) k left join s_base using (key) left join s_l using (key) left join s_g using (key))"""

_FUZZY = """
a as (select distinct c_name as ref_value, trim(lower(regexp_replace(c_name, '[^\\p{L}\\p{N}]', ' ', 'g'))) as t from customer),
al as (select c_custkey as id, case c_custkey % 3 when 0 then upper(replace(c_name, '#', '-')) when 1 then substr(c_name, 1, length(c_name) - 1) else substr(c_name, 1, 12) || substr(c_name, 14) end as alias from customer),
b as (select distinct alias as value, trim(lower(regexp_replace(alias, '[^\\p{L}\\p{N}]', ' ', 'g'))) as t from al),
pairs as (select value, ref_value, round_even((1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t))) * 100, 4) as score from a, b),
best as (select value, ref_value, score from (select *, row_number() over (partition by value order by score desc, ref_value) as rk from pairs where score >= 60) where rk = 1)"""

_TITLES = """
p as (select *, p_name || ' ' || p_brand || ' lot ' || p_partkey || ' ' || p_type as title from part),
s as (select p_partkey as id, title, p_partkey || ' ' || upper(split_part(p_name, ' ', -1)) || case when p_partkey % 2 = 0 then ' ' || split_part(p_name, ' ', 1) else '' end || ' Lot' as words,
  substr(title, 3, length(p_name) + 5) as whole from p),
short as (select id, words, case when id % 3 = 0 then substr(whole, 1, 4) || '~' || substr(whole, 6) else whole end as piece from s)"""


def _weighted(column: str) -> str:
    """CTEs ending in ``best``: the best title of each value, of all pairs."""
    text = lambda c: f"trim(lower(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]', ' ', 'g')))"
    words = lambda c: f"list_distinct(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> ''))"
    weight = lambda c: f"coalesce(list_sum(list_transform({c}, lambda w: length(w))), 0)"
    order = lambda c: f"array_to_string(list_sort(regexp_split_to_array({c}, '\\s+')), ' ')"
    ratio = lambda a, b: f"(1 - levenshtein({a}, {b}) / greatest(length(a.t), length(b.t))) * 100"
    return f"""{_TITLES},
a as (select *, {words('t')} as ws, {order('t')} as o from (select distinct {column} as value, {text(column)} as t from short)),
b as (select *, {words('t')} as ws, {order('t')} as o from (select distinct title as ref_value, {text('title')} as t from p)),
scales as (
  select a.value, b.ref_value, round_even({ratio('a.t', 'b.t')}, 4) as plain, round_even(round_even({ratio('a.o', 'b.o')}, 4) * 0.95, 4) as ordered,
    case when len(y) < 1.5 * len(x) then 1.0 when len(y) < 8 * len(x) then 0.9 else 0.6 end as scale, x, y, {weight('list_intersect(a.ws, b.ws)')} / least({weight('a.ws')}, {weight('b.ws')}) as share
  from a, b, lateral (select case when length(a.t) <= length(b.t) then a.t else b.t end as x, case when length(a.t) <= length(b.t) then b.t else a.t end as y)),
parts as (select *, (1 - list_min(list_transform(range(1, cast(len(y) - len(x) + 2 as bigint)), lambda i: levenshtein(x, substr(y, i, len(x))))) / len(x)) * 100 as fit from scales),
pairs as (select value, ref_value, greatest(plain, ordered, round_even(share * 95 * scale, 4), case when scale < 1 and fit >= 80 then round_even(fit * scale, 4) else 0 end) as score from parts),
best as (select value, ref_value, score from (select *, row_number() over (partition by value order by score desc, ref_value) as rk from pairs where score >= 60) where rk = 1)"""


_AGED_RISK = f""",
scored as (select "Invoice #", cast(round_even(least(100, greatest(0, round_even(abs("Delta") / (select max(abs("Delta")) from report) * 40, 1) + {_POINTS}
  + round_even(least(1, greatest(0, 1 - "Ref_Count" / 2)) * 15, 1) + coalesce(round_even(least(greatest(days, 0), 120) / 6, 1), 0))), 0) as integer) as "Risk Score", "Status", "Delta" from report left join ages on "Invoice #" = key)
select "Invoice #", "Risk Score", case when "Risk Score" <= 25 then '🟢 Low' when "Risk Score" <= 50 then '🟡 Medium' when "Risk Score" <= 75 then '🟠 High' else '🔴 Critical' end as "Risk Level", "Status", "Delta" from scored"""

SQL: dict[str, str] = {
    "clean_key": f'with {TABLES} select "Invoice", {key("\"Invoice\"")} as key from base',
    "parse_amount": f"""with {TABLES} select "Invoice", "Amount", {money_of('"Amount"')} as amount_value, try_cast(trim(replace(replace("Amount", ',', ''), '$', '')) as double) as aging_value from base""",
    "parse_date": f"""with {TABLES} select "Invoice", "Date", strftime({day_of('"Date"')}, '%Y-%m-%d') as day from base""",
    "age_bucket": f'with {TABLES} select "Invoice", {DAYS} as days, {BUCKET} as bucket from base',
    "date_cleanup": "select l_orderkey, l_linenumber, case when l_linenumber = 2 then '' else regexp_replace(strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'), ' 00:00:00$', '') end as ship_date from lineitem",
    "canonical_date": f"""with {TABLES} select "Invoice", strftime({day_of('"Date"')}, '%Y-%m-%d') as date_literal, upper("Priority") as text_literal from base""",
    "strict_subset": f'with {TABLES} select "Invoice No" as "Bank_Invoice No", "Priority" as "Bank_Priority", "Total" as "Bank_Total" from bank',
    "issues": f"""with {KEYED} select case when r2.key is null then '' else 'Ledger' end as "Match Source", count(*) as n_rows, count(*) as n_without, 'Broken' as source, 'missing column: No Such Column' as issue from b left join r2 on b.key = r2.key group by 1""",
    "detail_left": f"with {DETAIL} select {_SHOWN} from detail",
    "detail_full": f"with {FULL_DETAIL} select {_SHOWN} from full_detail",
    "match_count": f'with {DETAIL} select "Bank_Match_Count", "Ledger_Match_Count", count(*) as n_rows from detail group by 1, 2',
    "match_source": f'with {FULL_DETAIL} select "Match Source", count(*) as n_rows from full_detail group by 1',
    "dup_summary": f'with {DETAIL} select "Duplicate Summary", count(*) as n_rows from detail group by 1',
    "exact_join_raw": 'select o_orderkey, o_orderstatus, l_orderkey as "Lines_l_orderkey", l_linenumber as "Lines_l_linenumber", l_extendedprice as "Lines_l_extendedprice" from orders left join lineitem on o_orderkey = l_orderkey',
    "missing_in_ref": f"with {KEYED} select b.* exclude (key) from b anti join r1 on b.key = r1.key",
    "missing_in_base": f"with {KEYED} select r1.* exclude (key) from r1 anti join b on b.key = r1.key",
    "found_in_ref": f"with {KEYED} select b.* exclude (key) from b semi join r2 on b.key = r2.key",
    "disc_sums": f"with {LINES} select * from line_sums",
    "disc_status_1ref": f"with {_report(n=1)} {_STATUS}",
    "disc_status_2ref": f"with {_report()} {_STATUS}",
    "disc_full": f"with {_report(full=True)} select * from report",
    "disc_left": f"with {_report()} select * from report",
    "mismatched_fields": f'with {_report()} select "Mismatched Fields", "Status", count(*) as n_keys from every group by 1, 2',
    "compare_fields": f"""with {DETAIL},
x as (select "Invoice", {_compared('"Priority"', '"Bank_Priority"', "pr")}, {_compared('"Date"', '"Bank_Date"', "da")}, {_compared('"Customer"', '"Ledger_Customer"', "cu")} from detail),
y as (select "Invoice", {_kind("pr")}, {_kind("da")}, {_kind("cu")} from x),
z as (select "Invoice", concat_ws(', ', case when pr = 'm' then 'Priority' end, case when da = 'm' then 'Date' end, case when cu = 'm' then 'Customer' end) as wrong,
  concat_ws(', ', case when pr = 'p' then 'Priority' end, case when da = 'p' then 'Date' end, case when cu = 'p' then 'Customer' end) as part from y)
select "Invoice", coalesce(nullif(concat_ws(' | ', case when wrong <> '' then 'Mismatch: ' || wrong end, case when part <> '' then 'Partial: ' || part end), ''), '✓ All Match') as "Field Comparison" from z""",
    "schema_text": f"""with {DETAIL}, x as (select "Invoice", trim("Priority") as a, trim(coalesce("Bank_Priority", '')) as b from detail)
select "Invoice" as "Invoice #", a as "Priority (SOA)", b as "Priority (Bank)", case when b = '' then 'MISSING DATA' when {_CANON("a")} = {_CANON("b")} then 'MATCH'
  when contains(upper(a), upper(b)) or contains(upper(b), upper(a)) then 'PARTIAL MATCH' else 'MISMATCH' end as "Priority Status" from x""",
    "schema_number": f"""with {DETAIL}, x as (select "Invoice", {money_of('"Amount"')} as a, "Bank_Total" as b, "Ledger_Open Amount" as c from detail),
y as (select *, cast(a is not null as integer) + cast(b is not null as integer) + cast(c is not null as integer) as n from x)
select "Invoice" as "Invoice #", a as "Value (SOA)", b as "Value (Bank)", c as "Value (Ledger)", case when n = 0 then 'NO DATA' when n < 3 then 'MISSING DATA'
  when round_even(a, 2) = round_even(b, 2) and round_even(b, 2) = round_even(c, 2) then 'MATCH' else 'MISMATCH' end as "Value Status" from y""",
    "schema_date": f"""with {DETAIL}, x as (select "Invoice", trim("Date") as a, trim("Bank_Date") as b from detail)
select "Invoice" as "Invoice #", a as "Day (SOA)", b as "Day (Bank)", case when a = '' and b = '' then 'NO DATA' when a = '' or b = '' then 'MISSING DATA' when {_CANON("a")} = {_CANON("b")} then 'MATCH' else 'MISMATCH' end as "Day Status" from x""",
    "exec_summary": f"with {BOTH}, {SUMMARY} select * from summary",
    "data_summary": f"with {BOTH}, {SUMMARY} select * from data_summary",
    "status_breakdown": f"with {BOTH}, {SUMMARY} select * from status_breakdown",
    "risk_scores": f"with {_report()}, {RISK} select * from risk",
    "iqr_stats": f"with {BOTH}, {SUMMARY} select * from iqr_stats",
    "iqr_outliers": f"""with {LINES},
q as (select avg("Lines Amount") as m, stddev_samp("Lines Amount") as s, quantile_cont("Lines Amount", 0.25) as q1, quantile_cont("Lines Amount", 0.75) as q3 from line_sums)
select "ID / Key", "Lines Amount", case when "Lines Amount" > q3 + 1.5 * (q3 - q1) then '⬆ Above Upper' else '⬇ Below Lower' end as "Deviation", round_even(("Lines Amount" - m) / s, 2) as "Z-Score"
from line_sums, q where "Lines Amount" < q1 - 1.5 * (q3 - q1) or "Lines Amount" > q3 + 1.5 * (q3 - q1)""",
    "aging": f"""with {DETAIL}, x as (select "Age Bucket", count(*) as "Total Invoices", round_even(sum(coalesce(try_cast(trim(replace(replace("Amount", ',', ''), '$', '')) as double), 0)), 2) as v from detail group by 1)
select "Age Bucket", "Total Invoices", {_money_text("v")} as "Total Value", case when "Age Bucket" = '0-30' then '🟢 Safe' when "Age Bucket" = '31-60' then '🟡 Attention Required' when "Age Bucket" = 'Unknown' then '⚪ Unknown' else '🔴 High Risk' end as "Risk Level",
  cast(list_position(['0-30', '31-60', '61-90', '91-120', '121+', 'Unknown'], "Age Bucket") as integer) as ord from x""",
    "source_reliability": f"""with {DETAIL},
x as (select 'Bank' as "Source", coalesce("Bank_Invoice No", "Bank_Priority", cast("Bank_Total" as varchar)) is not null or "Bank_Date" is not null as here, abs(try_cast("Amount" as double) - "Bank_Total") as gap from detail
  union all select 'Ledger', "Ledger_Ref" is not null or "Ledger_Customer" is not null or "Ledger_Open Amount" is not null, abs(try_cast("Amount" as double) - "Ledger_Open Amount") from detail),
y as (select "Source", count(*) as n, count(*) filter (here) as p, count(gap) as b, count(*) filter (gap < 0.01) as e, avg(gap) as d from x group by 1),
z as (select *, round_even(p / n * 100, 1) as cov, round_even(e / b * 100, 1) as acc from y)
select "Source", cov as "Coverage", p as "Present", n - p as "Missing", e as "Exact Matches", acc as "Accuracy", round_even(d, 2) as "Avg Deviation",
  case when acc >= 95 and cov >= 90 then 'A+' when acc >= 90 and cov >= 80 then 'A' when acc >= 80 and cov >= 70 then 'B' when acc >= 70 then 'C' else 'D' end as "Grade" from z""",
    "top_discrepancies": f'with {_report()} select "Invoice #", "SOA Amount", "Bank Amount", "Ledger Amount", "Delta", "Status" from report order by abs("Delta") desc, "Invoice #" limit 10',
    "patterns": f"with {_report()}, {PATTERNS} select * from patterns",
    "fuzzy_best": f"with {_FUZZY} select * from best",
    "fuzzy_join": f"""with {_FUZZY} select al.alias as "Alias", al.id as "Id", coalesce(best.ref_value, 'No Match') as "Crm_Match_Key", c.c_name as "Crm_Name", c.c_custkey as "Crm_c_custkey"
from al left join best on al.alias = best.value left join customer c on c.c_name = best.ref_value""",
    "fuzzy_tokens": f"with {_weighted('words')} select * from best",
    "fuzzy_partial": f"""with {_weighted('piece')} select short.piece as "Piece", short.id as "Id", coalesce(best.ref_value, 'No Match') as "Parts_Match_Key", p.title as "Parts_Title", p.p_partkey as "Parts_p_partkey"
from short left join best on short.piece = best.value left join p on p.title = best.ref_value""",
    "report_classes": f"""with {_report()} select "Status", case when "Status" in ('NO DATA') then 'neutral' when "Status" = 'MATCH' then 'good' when "Status" like 'PARTIAL%' then 'bad' else 'bad' end as status_class,
  case when "Delta" < -0.01 then 'negative' when "Delta" > 0.01 then 'positive' else 'neutral' end as delta_class, count(*) as n_keys from every group by 1, 2, 3""".replace("when \"Status\" like 'PARTIAL%' then 'bad'", "when \"Status\" like 'PARTIAL%' then 'warn'"),
    "level_classes": f"""with {_report()}, {RISK} select "Risk Level", case when "Risk Level" like '%Low' then 'low' when "Risk Level" like '%Medium' then 'medium' when "Risk Level" like '%High' then 'high' else 'other' end as level_class, count(*) as n_keys from risk group by 1, 2""",
    "duplicate_flags": f'with {DETAIL} select "Bank_Match_Count" > 1 as "Bank_duplicate", "Ledger_Match_Count" > 1 as "Ledger_duplicate", count(*) as n_rows from detail group by 1, 2',
    "insights_table": f"""with {BOTH}, {SUMMARY}, {PATTERNS}
select 0 as ord, 'Total Records Processed' as "Metric", cast(total_records as varchar) as "Value" from summary
union all select 1, 'Match Rate', printf('%.1f', match_rate) || '%' from summary union all select 2, 'Matched Invoices', cast(match_count as varchar) from summary
union all select 3, 'Discrepancies Found', cast(discrepancy_count as varchar) from summary union all select 4, 'Total Discrepancy Value', {_money_text("total_discrepancy_value")} from summary
union all select 5, 'Average Discrepancy', {_money_text("avg_discrepancy")} from summary union all select 6, 'Maximum Discrepancy', {_money_text("max_discrepancy")} from summary
union all select 7, 'Reconciliation Health Score', printf('%.1f', health_score) || '/100' from summary union all select 8, 'Reference Sources', cast(ref_count as varchar) from summary
union all select 9, 'Generated At', '2001-08-02 00:00:00'
union all select 100, '[' || "Source" || '] Invoices', cast("Total Invoices" as varchar) from data_summary union all select 101, '[' || "Source" || '] Value Sum', {_money_text('"Total Value"')} from data_summary
union all select 102, '[' || "Source" || '] Match Rate', "Match Rate vs SOA" from data_summary
union all select 200, "Status", cast("Count" as varchar) from status_breakdown
union all select 300, '[' || severity || '] ' || type, description from patterns
union all select 400, 'Mean Amount', {_money_text("mean")} from iqr_stats union all select 401, 'Median Amount', {_money_text("median")} from iqr_stats union all select 402, 'Std Deviation', {_money_text("std_dev")} from iqr_stats
union all select 403, 'Outlier Count', cast(outlier_count as varchar) from iqr_stats union all select 404, 'Outlier Percentage', printf('%.1f', outlier_pct) || '%' from iqr_stats""",
    "preview": f"""with {_report()}, top as (select * from report order by "Status", "Delta", "Invoice #" limit 200)
select "Invoice #", {_number_text('"SOA Amount"')} as "SOA Amount", {_number_text('"Bank Amount"')} as "Bank Amount", {_number_text('"Ledger Amount"')} as "Ledger Amount", "Ref_Sources",
  cast("Ref_Count" as varchar) as "Ref_Count", {_number_text('"Delta"')} as "Delta", "Status", "Mismatched Fields" from top""",
    "header_stats": f"with {BOTH} select (select count(*) from detail) as total_rows, (select count(*) from detail) - (select count(*) from report) as matches, (select count(*) from report) as issues",
}

# the detail view of tables in which one key holds a third of the base
_HOT = DETAIL.replace("as key, * from base)", """as key, * from (select case when cast("Customer" as bigint) % 3 <> 0 then "Invoice" end as "Invoice", * exclude ("Invoice") from base))""").replace(
    "as key, * from bank)", """as key, * from (select case when "Invoice No" <> '1' then "Invoice No" end as "Invoice No", * exclude ("Invoice No") from bank))"""
)

SQL |= {
    "detail_left_hot_key": f"""with {_HOT} select "Invoice" is null as no_key, "Bank_Match_Count", "Ledger_Match_Count", "Bank_Date", count(*) as n_rows from detail group by all""",
    "risk_order": SQL["risk_scores"],
    "outlier_order": SQL["iqr_outliers"],
    "iqr_all_match": """with iqr as (select count(o_totalprice) as n, avg(o_totalprice) as mean, quantile_cont(o_totalprice, 0.5) as median, stddev_samp(o_totalprice) as std_dev, quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.75) as q3 from orders)
select round_even(mean, 2) as mean, round_even(median, 2) as median, round_even(std_dev, 2) as std_dev, round_even(q1, 2) as q1, round_even(q3, 2) as q3,
  round_even(q3 - q1, 2) as iqr, round_even(q1 - 1.5 * (q3 - q1), 2) as lower_bound, round_even(q3 + 1.5 * (q3 - q1), 2) as upper_bound, o.c as outlier_count, round_even(o.c / n * 100, 1) as outlier_pct
from iqr, (select count(*) as c from orders, iqr where o_totalprice < q1 - 1.5 * (q3 - q1) or o_totalprice > q3 + 1.5 * (q3 - q1)) o""",
    "report_sink": f"""with {BOTH}, {SUMMARY},
counts as (select 'detailed_view' as report, count(*) as n_rows from detail union all select 'discrepancy_report', count(*) from report union all select 'risk_analysis', count(*) from report
  union all select 'aging', count(distinct "Age Bucket") from detail union all select 'outliers', outlier_count from iqr_stats
  union all select 'normalized_comparison', (select count(*) from ({SQL["schema_text"]})) union all select 'reconciliation_insights', (select count(*) from ({SQL["insights_table"]})))
select * from counts where n_rows > 0""",
    "csv_scan": """select cast(c_custkey as varchar) as "Key", case c_custkey % 4 when 0 then 'say "hi", then ' || c_name when 1 then 'two' || chr(10) || 'lines of ' || c_name when 2 then c_name || chr(92) end as "Note",
  c_name as "Name", cast(c_acctbal as varchar) as "Balance" from customer""",
    "csv_pruned": 'select cast(c_custkey as varchar) as "Key", cast(c_acctbal as varchar) as "Balance" from customer',
    "date_orders": """with t as (select o_orderkey, o_orderdate + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60) as w, o_orderkey % 10 as form from orders)
select o_orderkey, strftime(case when form in (0, 4) then date_trunc('day', w) when form in (1, 2, 3) then date_trunc('month', w) when form = 7 then date_trunc('hour', w)
  when form = 6 and day(w) <= 12 then make_timestamp(year(w), day(w), month(w), hour(w), minute(w), 0.0) else w end, '%Y-%m-%d %H:%M:%S') as day from t""",
    "issues_isolated": f"""with {KEYED}, found as (select case when r2.key is null then '' else 'Ledger' end as "Match Source", count(*) as n_rows, count(case when r2."Ref" % 20 <> 1 then 1 end) as n_amounts
  from b left join r2 on b.key = r2.key group by 1)
select * from found cross join (select 'Bank' as source, 'cannot be read' as issue union all select 'Ledger', 'rows with too few or too many cells: ' || count(*) from ledger where "Ref" % 20 = 1)""",
    "date_spellings": "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as day from orders",
    "detail_full_null_apart": f"""with {TABLES},
b as (select case when "Invoice" not like '%77%' then {key('"Invoice"')} end as key from base),
r1 as (select case when "Invoice No" not like '%77%' then {key('"Invoice No"')} end as key from bank),
r2 as (select case when cast("Ref" as varchar) not like '%77%' then {key('"Ref"')} end as key from ledger),
c1 as (select key, count(*) as n from r1 where key is not null group by key), c2 as (select key, count(*) as n from r2 where key is not null group by key),
x as (select coalesce(b.key, r1.key) as key, b.key is not null or (b.here and b.key is null) as in_b, b.here, r1.here as in_1 from (select key, true as here from b) b full join (select key, true as here from r1) r1 on b.key = r1.key),
y as (select coalesce(x.key, r2.key) as key, x.here as in_b, x.in_1, r2.here as in_2 from x full join (select key, true as here from r2) r2 on x.key = r2.key)
select y.key is null as no_key,
  case when y.key is null then (case when in_b then 0 when in_1 then 1 end) when in_b or c1.n is not null then coalesce(c1.n, 0) end as "Bank_Match_Count",
  case when y.key is null then (case when in_2 then 1 else 0 end) else coalesce(c2.n, 0) end as "Ledger_Match_Count",
  concat_ws(', ', case when c1.n > 0 then 'Bank' end, case when c2.n > 0 then 'Ledger' end) as "Match Source", count(*) as n_rows
from y left join c1 on y.key = c1.key left join c2 on y.key = c2.key group by all""",
    "source_reliability_default": SQL["source_reliability"].replace("""coalesce("Bank_Invoice No", "Bank_Priority", cast("Bank_Total" as varchar)) is not null or "Bank_Date" is not null as here""", "true as here").replace(
        """"Ledger_Ref" is not null or "Ledger_Customer" is not null or "Ledger_Open Amount" is not null,""", "true,"
    ),
    "risk_with_age": f"with {BOTH}, ages as (select {key('\"Invoice\"')} as key, max(\"Age (Days)\") as days from detail group by 1){_AGED_RISK}",
    "risk_first_age": f"""with {BOTH}, ages as (select cast(o_orderkey as varchar) as key, arg_min(o_orderkey * (copy + 1) % 200, (o_orderkey * 7919 + copy * 104729) % 1000003) as days
  from orders cross join (values (0), (1)) as t(copy) where o_orderkey % 9 <> 0 or copy = 1 group by 1){_AGED_RISK}""",
}
SQL["report_commit"] = SQL["risk_scores"]
SQL |= {
    "written_figures": f"""with {BOTH}, {SUMMARY}, header as (
  select true as summary, total_records as total_rows, match_count as matches, discrepancy_count as issues from summary union all select false, total_records, 0, discrepancy_count from summary)
select * from header, summary s, status_breakdown""",
    "header_without_summary": f"""with {BOTH} select (select count(*) from detail) as total_rows, count(*) filter ("Status" = 'MATCH') as matches, count(*) filter ("Status" <> 'MATCH') as issues from every""",
    "aging_classes": f"""select "Age Bucket", "Risk Level", case "Age Bucket" when '0-30' then 'safe' when '31-60' then 'attention' when 'Unknown' then 'other' else 'risk' end as level_class from ({SQL["aging"]})""",
    "report_contents": f"""select 'discrepancy_report' as report, "Invoice #" as item, "Status" as said from ({SQL["disc_left"]})
union all select 'risk_analysis', "Invoice #", "Risk Level" from ({SQL["risk_scores"]}) union all select 'reconciliation_insights', "Metric", "Value" from ({SQL["insights_table"]})""",
}
SQL["detail_bucketed"] = SQL["detail_left"]
