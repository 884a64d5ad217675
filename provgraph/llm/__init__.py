"""Operators for preparing training text at scale.

Nothing outside this folder imports it.  ``queries`` holds the registered
queries and their SQL; every other module is one operator or shared code.
"""
