"""Operators for preparing language-model training data at corpus scale.

Nothing outside this package imports it. Each module holds one operator with a
general interface and the contract query ``opN_<name>`` built on it.
"""
