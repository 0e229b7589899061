"""Word lists, lookup tables and constants, stated as plain text.

Every table here is small and fixed (its size is checked where it is turned
into an expression), so operators inline it into the plan as a literal: no
join, no shuffle, no broadcast of anything that grows with the data.
Knowledge bases that can grow are always DataFrame parameters instead.
"""
