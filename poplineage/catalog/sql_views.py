"""SQL of the inputs and of the stages that several queries share."""

from __future__ import annotations

from ..schemas import PARAMS
from .views import MULTIPLIERS


def params(of: str = "mutationId") -> str:
    return ", ".join(f"((({of} * {m}) % 997)::double / 997::double)::float as p{i}" for i, m in enumerate(MULTIPLIERS))


def rounded_params(prefix: str = "p") -> str:
    return ", ".join(f"round({prefix}{i}::double, 6) as {p}" for i, p in enumerate(PARAMS))


EV = """ev as (
  select event_id as ord, (epoch_us(ts) - 1704067200000000)::double / 86400000000::double as time,
    regexp_extract(props, '[0-9]+')::int as timeDelta,
    case event_type when 'signup' then 1 when 'error' then 2 else 4 end as eventKind,
    (user_id % 10)::double as x, (user_id // 10)::double as y, 0::double as z,
    1 + event_id % 64 as mutationId
  from events)"""


# The log of the jobs: removals begin late, so that every mutation is there before, and a quarter of the rows are rare mutations.
JOB_EV = """ev as (
  select event_id as ord, (epoch_us(ts) - 1704067200000000)::double / 86400000000::double as time,
    regexp_extract(props, '[0-9]+')::int as timeDelta,
    case when event_type = 'signup' then 1 when event_type = 'error' and event_id >= 512 then 2 else 4 end as eventKind,
    (user_id % 10)::double as x, (user_id // 10)::double as y, 0::double as z,
    1 + event_id % (case when event_id % 4 = 0 then 512 else 8 end) as mutationId
  from events)"""


def groups(rule: str = ">=", source: str = EV) -> str:
    return f"""{source},
lagged as (select *, lag(timeDelta, 1, 0) over (order by ord) as before from ev),
grp as (select * exclude (before),
    sum((timeDelta {rule} before)::bigint) over (order by ord rows unbounded preceding)::bigint as eventId
  from lagged)"""


def _linear(source: str, shift: int, kind_aware: bool) -> str:
    parent = f"lag(ord + {shift}) over (partition by x, y, z order by eventId, ord)"
    if kind_aware:
        parent = f"case when eventKind <> 1 then {parent} end"
    return f"""lin as (select * from (
  select ord + {shift} as particleId, {parent} as parentId, time as birthTime,
    lead(time, 1, 'infinity'::double) over (partition by x, y, z order by eventId, ord) as deathTime,
    x, y, z, mutationId, eventId, eventKind
  from {source}) where eventKind <> 2)"""


RESOLVED = """chron as (
  select s.particleId, coalesce(o.parentId, 0) as parentId, s.birthTime, s.deathTime, s.x, s.y, s.z, s.mutationId
  from (select * from lin where parentId is null) s
  left join (select eventId, parentId from lin where parentId is not null) o using (eventId)
  union all
  select particleId, parentId, birthTime, deathTime, x, y, z, mutationId from lin where parentId is not null)"""

LINEAR = f"{groups()}, {_linear('grp', 1, False)}"
CHRON = f"{LINEAR}, {RESOLVED}"
CHRON_KIND_AWARE = f"{groups()}, {_linear('grp', 1, True)}, {RESOLVED}"

WITH_INITIAL = f"""{groups()},
cube as (select i, (i // 25 - 2)::double as x, (i // 5 % 5 - 2)::double as y, (i % 5 - 2)::double as z
  from (select unnest(range(125)) as i)),
started as (
  select i - 125 as ord, '-infinity'::double as time, i::int as timeDelta, 1 as eventKind, x, y, z,
    1::bigint as mutationId, 0::bigint as eventId from cube
  union all
  select ord, time, timeDelta, eventKind, x, y, z, mutationId, eventId from grp)"""
CHRON_WITH_INITIAL = f"{WITH_INITIAL}, {_linear('started', 126, False)}, {RESOLVED}"

# One cell of the first mutation for each user stands ahead of the rows of the log.
JOB_CHRON = f"""{groups(source=JOB_EV)},
started as (
  select user_id as ord, '-infinity'::double as time, user_id::int as timeDelta, 1 as eventKind, (user_id % 10)::double as x,
    (user_id // 10)::double as y, 0::double as z, 1::bigint as mutationId, 0::bigint as eventId
  from (select distinct user_id from events)
  union all
  select ord + (select max(user_id) + 1 from events), time, timeDelta, eventKind, x, y, z, mutationId, eventId from grp),
{_linear('started', 1, False)}, {RESOLVED}"""

POINTS = """last as (select max(birthTime) as m from chron),
points as (
  select t from (select unnest(range(greatest(ceil(m)::bigint, 0)))::double as t, m from last) where t < m
  union all select m from last)"""
COVERED = """covered as (
  select c.*, p.t as timePoint from chron c join points p on c.birthTime <= p.t and p.t < c.deathTime)"""
SNAPS = f"""{CHRON}, {POINTS}, {COVERED},
snaps as (select mutationId, timePoint, count(*) as count, {params()} from covered group by mutationId, timePoint)"""

TREE = """branches as (
  select c.mutationId, c.birthTime as time, c.particleId, c.parentId, coalesce(p.mutationId, 0) as parentMutationId
  from chron c left join chron p on c.parentId = p.particleId
  where c.mutationId <> coalesce(p.mutationId, 0)),
tree as (
  select mutationId, parentMutationId, time from (
    select *, row_number() over (partition by mutationId order by time, particleId, parentId, parentMutationId) as n
    from branches) where n = 1)"""
TREE_OF_EV = f"""{CHRON},
{TREE}"""

CS = f"""cs as (
  select *, {params()} from (
    select year(l_shipdate)::double as timePoint, l_suppkey + 1 as mutationId, count(*) as count
    from lineitem group by 1, 2))"""
FINAL = "final as (select mutationId, count from cs where abs(timePoint - (select max(timePoint) from cs)) < 0.001)"

TR = f"""tr as (
  select *, {params()} from (
    select s_suppkey + 1 as mutationId, (s_suppkey + 1) // 2 as parentMutationId,
      case when s_suppkey = 0 then '-infinity'::double else (s_suppkey + 1) / 4::double end as time
    from supplier))"""
PATHS = """paths as (
  select 1::bigint as mutationId, [1::bigint] as ancestors
  union all
  select t.mutationId, list_append(p.ancestors, t.mutationId)
  from tr t join paths p on t.parentMutationId = p.mutationId where t.mutationId <> 1)"""
CARRIED = """carried as (
  select a as mutationId, sum(coalesce(n, 0))::bigint as mutationCount from (
    select unnest(p.ancestors) as a, f.count as n from paths p left join final f using (mutationId))
  group by a)"""
SUMMED = f"""summary as (
  select t.mutationId, coalesce(f.count, 0)::bigint as typeCount, c.mutationCount, p.ancestors, t.time,
    t.time - greatest(0, coalesce(u.time, 0)) as waitingTime,
    {", ".join(f"t.p{i}" for i in range(6))}, {", ".join(f"(t.p{i} - u.p{i}) as d{i}" for i in range(6))}
  from tr t join carried c using (mutationId) join paths p using (mutationId)
  left join final f using (mutationId) left join tr u on t.parentMutationId = u.mutationId)"""
SUMMARY = f"{CS}, {FINAL}, {TR}, {PATHS}, {CARRIED}, {SUMMED}"
