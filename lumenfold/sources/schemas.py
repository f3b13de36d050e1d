"""The schemas of captured tables."""

SCHEMAS = {
    "captures": "capture_id string, kind string, share_url string, base string, page_title string, page_url string, captured_at timestamp",
    "net_bodies": "capture_id string, seq int, url string, resource_type string, body string",
    "dom_html": "capture_id string, frame_id int, snap_seq int, html string",
    "frags": "capture_id string, ord int, t string, x0 double, y0 double, x1 double, y1 double, sz double, ui boolean",
    "links": "capture_id string, ord int, ax double, ay double, bx double, by double, length double",
    "quiz_states": "capture_id string, step int, phase string, root string, options array<struct<i:int,raw:string,attrs:string>>",
}
