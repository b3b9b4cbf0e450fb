"""codemill.plans"""
