"""codemill.functions"""
