"""SQL of the queries over regions of pictures of 64 rows."""

from deepledger.sources import adapters as A

#: Rows of a picture, and the level above which a pixel is in its mask.
TALL, MASK_LEVEL = 64, 129

_PIXELS = f"""raw as (select vec_id, unnest(embedding) as x, unnest(range(0, len(embedding))) as i from embeddings),
    pixels as materialized (select vec_id // {TALL} as image_id, (vec_id % {TALL})::int as "row", i::int as col, greatest(0, least(255, floor(128 + x::double * 32)))::bigint as v from raw)"""

_BOXES = f"""{A.DETECTIONS}, {_PIXELS}, boxes as (select image_id % (select max(vec_id) // {TALL} + 1 from embeddings) as image_id, detection_id as box,
        (x::bigint % {TALL} - 3)::int as x, (y::bigint % {TALL} - 3)::int as y, (w::bigint % 7 + 1)::int as w, (h::bigint % 9 + 1)::int as h from detections),
    sizes as (select image_id, max("row") + 1 as height, max(col) + 1 as width, count(*) as all_n, sum(v) as all_s, sum(v * v) as all_q from pixels group by 1),
    known as (select *, greatest(0, x) as x0, greatest(0, y) as y0, least(width, x + w) as x1, least(height, y + h) as y1 from boxes join sizes using (image_id))"""


def _sums(rects: str) -> str:
    return f'select r.*, count(*) as n, sum(v)::double as s, sum(v * v)::double as q from (select distinct image_id, x0, y0, x1, y1 from {rects}) r join pixels p on p.image_id = r.image_id and "row" >= y0 and "row" < y1 and col >= x0 and col < x1 group by all'


MASK_BOXES = f"""with recursive {_PIXELS}, m as (select image_id, "row", col, col - row_number() over (partition by image_id, "row" order by col) as island from pixels where v > {MASK_LEVEL}),
    runs as materialized (select image_id, "row", min(col) as c0, max(col) as c1, count(*) as area, "row" * 4294967296 + min(col) as node from m group by image_id, "row", island),
    links as materialized (select a.image_id, a.node as v, b.node as u from runs a join runs b on b.image_id = a.image_id and b."row" = a."row" + 1 and a.c0 <= b.c1 + 1 and b.c0 <= a.c1 + 1),
    ties as materialized (select image_id, u, v from links union all select image_id, v, u from links),
    reach as (select image_id, node, node as root from runs union select r.image_id, b.u, r.root from reach r join ties b on b.image_id = r.image_id and b.v = r.node and r.root < b.u),
    roots as (select image_id, node, min(root) as root from reach group by 1, 2),
    c as (select image_id, root, min(c0) as x, min("row") as y, max(c1) - min(c0) + 1 as w, max("row") - min("row") + 1 as h, sum(area)::bigint as area from runs join roots using (image_id, node) group by 1, 2)
    select image_id, row_number() over (partition by image_id order by root)::int as k, x, y, w, h, area from c where area >= 48 and w * h >= 64"""

BOX_STATISTICS = f"""with {_BOXES}, inside as (select * from known where x1 > x0 and y1 > y0), sums as ({_sums("inside")})
    select image_id, box, n, round(s / n, 6) as mean, round(sqrt(greatest(0.0::double, n * q - s * s)) / n, 6) as deviation from inside join sums using (image_id, x0, y0, x1, y1)"""

_SLANT = "range_m * greatest(0.0::double, least(1.0::double, ({row})::double / (height - 1)))"
_GROUND = f"sqrt(greatest(0.0::double, pow({_SLANT}, 2) - altitude_m * altitude_m))"

BOX_SHADOWS = f"""with {_BOXES}, fit as (select *, greatest(4, greatest(w, h) // 2) as pad from known where x1 > x0 and y1 > y0),
    padded as (select image_id, box, greatest(0, x0 - pad) as x0, greatest(0, y0 - pad) as y0, least(width, x1 + pad) as x1, least(height, y1 + pad) as y1 from fit), sums as ({_sums("padded")}),
    part as (select image_id, box, n, s, q from padded join sums using (image_id, x0, y0, x1, y1)),
    back as (select f.*, all_n - n >= 200 as far_off, case when far_off then all_n - n else n end::double as bn, case when far_off then all_s - s else s end as bs, case when far_off then all_q - q else q end as bq from fit f join part using (image_id, box)),
    below as (select *, bs / bn as mean, sqrt(greatest(0.0::double, bn * bq - bs * bs)) / bn + 1e-6::double as sd, least(height, y + h) as top, least(height, y + h + greatest(8, 4 * h)) as bottom from back where least(height, y + h + greatest(8, 4 * h)) > least(height, y + h)),
    looked as (select image_id, box, x0, x1, w, top, mean, sd, unnest(range(top, bottom)) as "row" from below),
    profile as (select image_id, box, w, x1 - x0 as wide, l."row" - top as i, any_value(top) as top, any_value(mean) as mean, any_value(sd) as sd, sum(v) as s, sum(v) / (x1 - x0) as p, any_value(x0) as x0, any_value(x1) as x1
        from looked l join pixels using (image_id, "row") where col >= x0 and col < x1 group by image_id, box, w, x1 - x0, l."row" - top),
    begun as (select *, min(case when p < mean - 0.75::double * sd then i end) over (partition by image_id, box) as start from profile),
    ended as (select *, coalesce(min(case when i >= start and p >= mean - 1.5::double * sd then i end) over (partition by image_id, box), count(*) over (partition by image_id, box)) - start as length from begun),
    run as (select *, sum(s) over (partition by image_id, box) as dark from ended where start <= 6 and length >= 2 and i >= start and i < start + length),
    cols as (select r.image_id, box, w, length, col, count(*) filter (where v * length * wide < dark) as k from run r join pixels x on x.image_id = r.image_id and x."row" = top + i and col >= x0 and col < x1 group by r.image_id, box, w, length, col),
    valids as (select image_id, box from cols group by image_id, box, w having count(*) filter (where 2 * k > length) >= 0.5::double * w),
    spans as (select distinct image_id, box, start, length from ended),
    o as (select k.*, start, length, s.box is not null as looked, v.box is not null as valid, range_m, altitude_m from known k left join spans s using (image_id, box) left join valids v using (image_id, box) left join (select image_id, range_m, altitude_m from frames) f using (image_id)),
    g as (select *, {_GROUND.format(row="y1 + start + length")} as far, {_GROUND.format(row="y1 + start")} as near from o),
    l as (select *, case when valid and range_m <> 0 and altitude_m > 0 and far > 0 then greatest(far - near, 1e-6::double) end as ground from g)
    select image_id, box, valid, case when valid then length end::int as length_px, case when looked then case when valid then round(0.5::double + 0.4::double * least(1.0::double, length / greatest(0.5::double * h, 1.0::double)), 6) else 0 end end as evidence,
        round(ground, 2) as length_m, round(altitude_m * ground / far, 2) as height_m from l"""
