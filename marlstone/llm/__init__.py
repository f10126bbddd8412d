"""Operators for preparing training data at scale.

Every module holds one operator with a general interface.  ``registry`` holds
the thin queries over the driver's tables and their SQL.  Nothing outside this
package imports it.
"""
