"""Training-data operators: dedup, filtering, formatting, mixing, sharding and token encoding.

Each module holds one operator with its own general interface; ``queries`` registers the
``opN_<name>`` queries over the whole driver tables.  Nothing outside this package imports it
except the entry module, which adds its queries only when the package is present.
"""
