"""Fixed test values: requirement and patch texts of the three golden scenarios.

The expected claims and conflicts depend on every word of them.
"""

SCENARIO_1 = {
    "requirement": "Add organisation billing. Only organisation owners may manage subscriptions.",
    "patches": {
        "auth-roles": """\
--- a/src/auth/roles.ts
+++ b/src/auth/roles.ts
@@ -1,6 +1,7 @@
-export type Role = 'admin' | 'member';
+export type Role = 'owner' | 'member';
 
-const PRIVILEGED_ROLE: Role = 'admin';
+// Renamed from 'admin' → 'owner' to match the requirement
+const PRIVILEGED_ROLE: Role = 'owner';
 
 export interface User {
   id: string;
""",
        "billing-subscriptions": """\
--- a/src/billing/permissions.ts
+++ b/src/billing/permissions.ts
@@ -1,5 +1,17 @@
 import type { User } from '../auth/roles.js';
 
-// TODO: implement subscription permission gate
-export function canManageSubscription(_user: User): boolean {
-  return false;
+/**
+ * Returns true if the user is allowed to manage organisation subscriptions.
+ * Requirement: only organisation owners may manage subscriptions.
+ */
+export function canManageSubscription(user: User): boolean {
+  // BUG: checks 'admin' but Branch A renamed the privileged role to 'owner'
+  return user.role === 'admin';
+}
+
+export function manageSubscription(user: User): void {
+  if (!canManageSubscription(user)) {
+    throw new Error('Unauthorised: only organisation owners can manage subscriptions');
+  }
+  // ... subscription management logic ...
 }
""",
    },
}

SCENARIO_2 = {
    "requirement": (
        "Implement an activity-feed service that records actions performed by users. "
        "The event payload must include the acting user's identifier."
    ),
    "patches": {
        "event-payload": """\
--- a/src/events/payload.ts
+++ b/src/events/payload.ts
@@ -1,8 +1,8 @@
 /**
  * Shared event payload emitted by all platform services.
+ * Field renamed user_id → userId for camelCase consistency.
  */
 export interface EventPayload {
-  /** Legacy snake_case identifier for the acting user */
-  user_id: string;
+  /** camelCase user identifier — replaces legacy user_id */
+  userId: string;
   action: string;
   resourceType: string;
   resourceId: string;
""",
        "activity-feed": """\
--- a/src/activity-feed/handler.ts
+++ b/src/activity-feed/handler.ts
@@ -1,5 +1,22 @@
 import type { EventPayload } from '../events/payload.js';
 
-// Activity-feed handler — stub on base branch
-export function handleEvent(_event: EventPayload): void {
-  // TODO: implement
+export interface ActivityRecord {
+  actorId: string;
+  action: string;
+  resourceType: string;
+  resourceId: string;
+  recordedAt: string;
+}
+
+/**
+ * Converts an incoming platform event into an activity-feed record.
+ *
+ * CONTRACT BUG: reads event.user_id, but Branch A renamed that field to userId.
+ * After merge, actorId will always be undefined — silently corrupt data.
+ */
+export function handleEvent(event: EventPayload): ActivityRecord {
+  return {
+    actorId: (event as unknown as Record<string, string>)['user_id'] ?? '',
+    action: event.action,
+    resourceType: event.resourceType,
+    resourceId: event.resourceId,
+    recordedAt: event.occurredAt,
+  };
 }
""",
    },
}

SCENARIO_3 = {
    "requirement": (
        "Allow users to sign up with only a username and password (email optional). "
        "The notification service must continue to send welcome emails to new users."
    ),
    "patches": {
        "username-signup": """\
--- a/src/users/model.ts
+++ b/src/users/model.ts
@@ -3,7 +3,8 @@
  */
 export interface User {
   id: string;
   username: string;
-  /** Required: every user must have an email address */
-  email: string;
+  /** Optional: users may register without an email address */
+  email?: string;
   createdAt: string;
 }
--- a/src/users/register.ts
+++ b/src/users/register.ts
@@ -3,7 +3,7 @@ import type { User } from './model.js';
 export interface RegistrationInput {
   username: string;
-  email: string;
+  email?: string;        // optional — username-only signup supported
   passwordHash: string;
 }
 
@@ -12,7 +12,7 @@ export function buildUser(input: RegistrationInput): User {
     id: crypto.randomUUID(),
     username: input.username,
-    email: input.email,
+    ...(input.email !== undefined ? { email: input.email } : {}),
     createdAt: new Date().toISOString(),
   };
 }
""",
        "welcome-email": """\
--- a/src/notifications/welcome-email.ts
+++ b/src/notifications/welcome-email.ts
@@ -1 +1,24 @@
-// Stub — welcome-email not yet implemented
+import type { User } from '../users/model.js';
+
+export interface EmailMessage {
+  to: string;
+  subject: string;
+  body: string;
+}
+
+/**
+ * Builds the welcome email for a newly registered user.
+ *
+ * DEPENDENCY BUG: assumes user.email is always defined.
+ * Branch A made email optional — after merge this is potentially undefined.
+ */
+export function buildWelcomeEmail(user: User): EmailMessage {
+  return {
+    to: user.email,           // BUG: user.email may be undefined after Branch A's change
+    subject: 'Welcome to the platform!',
+    body: `Hi ${user.username}, thanks for joining us!`,
+  };
+}
+
+export function sendWelcomeEmail(user: User, send: (msg: EmailMessage) => void): void {
+  const msg = buildWelcomeEmail(user);
+  send(msg);
+}
""",
    },
}

SCENARIOS = {"1": SCENARIO_1, "2": SCENARIO_2, "3": SCENARIO_3}
