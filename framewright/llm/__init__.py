"""Operators for preparing training corpora at scale.

Each module holds one operator with its own general interface; ``queries``
derives the fixed result columns of the ``opN_<name>`` queries from them.
Nothing outside this subpackage imports it.
"""
