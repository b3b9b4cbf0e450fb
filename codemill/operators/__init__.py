"""codemill.operators"""
