"""Pieces of the checking SQL. They restate the semantics relationally and share nothing with the operators."""

from __future__ import annotations

# Half-up on the printed value, which is how Spark rounds doubles. Doubles print up to 17 digits; a scale
# of 12 would round such a value once before the rounding that is meant.
def rounded(x: str, places: int) -> str:
    return f"cast(round(cast(cast({x} as varchar) as decimal(38,18)), {places}) as double)"


EVENTS = """
ev as (
  select cast(event_id as varchar) as event_id,
         'u' || lpad(cast(user_id as varchar), 6, '0') as user_id,
         case event_type when 'click' then 'add_to_cart' when 'error' then 'refund' else event_type end as event_type,
         'p' || lpad(regexp_extract(props, '[0-9]+'), 5, '0') as product_id,
         'category-' || cast(cast(regexp_extract(props, '[0-9]+') as integer) % 8 as varchar) as category,
         value as amount,
         'USD' as currency,
         ts as event_ts,
         cast(null as varchar) as session_id,
         case event_id % 4 when 1 then 'web' when 2 then 'ios' when 3 then 'android' end as device,
         event_id as n
  from events
)"""


def windows(name: str, length_s: int, slide_s: int, source: str = "ev", keep: str = "true") -> str:
    """CTEs ending in ``name``: one row per (user, window); ``keep`` filters (event, window) pairs."""
    length, slide = length_s * 1_000_000, slide_s * 1_000_000
    copies = -(-length_s // slide_s)
    return f"""
{name}_placed as (
  select e.*, (epoch_us(event_ts) // {slide}) * {slide} - k * {slide} as start_us
  from {source} e, range(0, {copies}) r(k)
  where (epoch_us(event_ts) // {slide}) * {slide} - k * {slide} + {length} > epoch_us(event_ts)
    and {keep.format(end=f"make_timestamp((epoch_us(event_ts) // {slide}) * {slide} - k * {slide} + {length})")}
),
{name}_sums as (
  select user_id, start_us,
         count(*) as event_count,
         count(*) filter (where event_type = 'view') as view_count,
         count(*) filter (where event_type = 'add_to_cart') as cart_count,
         count(*) filter (where event_type = 'purchase') as purchase_count,
         cast(sum(case when event_type = 'purchase' then cast(amount as decimal(18,4)) else 0 end) as double) as spend,
         cast(sum(case when event_type = 'refund' then cast(amount as decimal(18,4)) else 0 end) as double) as refunds,
         count(distinct product_id) as distinct_products,
         count(distinct category) as distinct_categories,
         max(epoch_us(event_ts)) // 1000 as last_event_ms
  from {name}_placed group by user_id, start_us
),
{name} as (
  select user_id, make_timestamp(start_us) as window_start, make_timestamp(start_us + {length}) as window_end,
         event_count, view_count, cart_count, purchase_count,
         {rounded("spend", 2)} as spend,
         {rounded("refunds", 2)} as refund_amount,
         case when purchase_count > 0 then {rounded("spend / purchase_count", 2)} end as avg_order_value,
         case when cart_count > 0 then {rounded("purchase_count / cart_count", 4)} end as cart_conversion,
         distinct_products, distinct_categories, last_event_ms,
         (start_us + {length}) // 1000 as window_end_ms
  from {name}_sums
)"""


PROFILE = """
profile as (
  select user_id, event_type as last_event_type, category as last_category, product_id as last_product_id,
         device as last_device, epoch_us(event_ts) // 1000 as last_seen_ms
  from (select *, row_number() over (partition by user_id order by event_ts desc, event_id desc) as rn from ev)
  where rn = 1
)"""


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(c.strip() for c in ctes) + "\n"
