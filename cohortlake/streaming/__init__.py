"""Empty on purpose: the operators this library re-expresses are all batch.

Time is an integer day column, there is no watermark, trigger or late data, so
no streaming operator is offered.
"""
