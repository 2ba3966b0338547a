"""DataFrame operators.

Two rules hold throughout.  Raw readings may be badly skewed (one site can hold a third of the rows),
so whatever touches them is a grouped aggregate that combines inside the map tasks before it
shuffles.  Windows are used only after ``dedup_site_hour`` or an aggregate, where a group is a site-day
(25 rows at most) or smaller.
"""
