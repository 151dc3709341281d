"""Training-data operators: deduplication, counting, rules, ranking, packing, language, chat, leaks, licenses.

Nothing outside this folder imports it; deleting it leaves the profile engine whole.
"""
